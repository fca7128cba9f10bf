"""The rule library: what is looked for in a clause, and what it means.

Notation in the patterns: ~40~ is a shortest gap of at most 40 characters inside
one sentence part; ~tail~ carries a quote on to the end of its phrase; ~they~ is
the company (we, us, its defined names); ~data~, ~parties~, ~at_will~ and
~number~ are the vocabularies below. A pattern written as a pair has a
confidence of its own.
"""

from __future__ import annotations

import re

# Vocabularies, patterns, confidences and weights decide which
# clause gets which label, so they are stated as they must be.
VOCABULARY = {
    "tail": r"(?P<tail>(?:[^.;,!?\n]|\.(?=\S)){0,60})",
    "data": r"(?:personal (?:data|information|details)|(?:your|user|customer|health|location|usage) (?:data|information|details)|your (?:name|email|contacts|location|activity)|(?:data|information) about you)",
    "parties": r"(?:(?:business |commercial |advertising |marketing )?partners?|advertis\w*|third[- ]part(?:y|ies)|data brokers?|affiliates|sponsors|insurers|employers)",
    "at_will": r"(?:at any time|for any (?:or no )?reason|for no reason|without (?:prior |advance )?(?:notice|cause|reason|warning|explanation|liability)|with or without (?:notice|cause)|in (?:our|its) (?:sole|absolute) discretion)",
    "number": r"(?:\d+|one|two|three|six|seven|ten|twelve|fourteen|thirty|sixty|ninety)(?: \(\d+\))?",
}
COMPANY_WORDS = ("we", "us", "the company", "company")

# id, topic, favours, base confidence, weight, flags (negatable, not_you), strong, unless, patterns
RULES: tuple[tuple, ...] = (
    ("arbitration", "Forced arbitration", "them", "medium", 95, "negatable", r"\bbinding\b|\bfinal\b|\bexclusively\b|\bsolely\b|\bagrees? to arbitrate\b", None, (
        r"\b(?:final and )?binding (?:individual |confidential )?arbitration\b",
        r"\b(?:resolved|settled|decided|determined|heard)\b~40~\b(?:by|through|in|via) (?:final |binding |individual |confidential )*arbitration\b",
        r"\b(?:agree|agrees|required|consent) to (?:binding )?arbitrat(?:e|ion)\b",
        r"\bsubmit(?:ted)?\b~40~\bto (?:final |binding |individual )*arbitration\b",
        r"\b(?:referred|go|goes|brought) to (?:binding )?arbitration\b",
        (r"\barbitration (?:agreement|provision|clause)\b", "low"),
    )),
    ("class_waiver", "Class-action waiver", "them", "high", 90, "", None, r"\b(?:nothing\b~40~\b(?:prevents?|stops?|restricts?|limits?|prohibits?)|(?:does|do|will|shall) not (?:prevent|stop|restrict|limit|prohibit|waive))\b~50~\bclass\b", (
        r"\b(?:waive|waives|waiving|give up|giving up|waiver of)\b~80~\b(?:class|collective|representative|group)(?:[- ]wide)?[- ](?:action|arbitration|proceeding|lawsuit|suit|claim)s?\b",
        r"\b(?:class|collective|representative)[- ](?:action|arbitration|proceeding|lawsuit)s?\b~40~\b(?:are|is) (?:not (?:permitted|allowed|available)|waived|prohibited)\b",
        r"\b(?:only|solely) (?:on|in) (?:an|your|their) individual (?:basis|capacity)\b",
        r"\bnot as (?:a )?(?:plaintiff|class member|representative)\b~tail~",
        r"\b(?:may not|cannot|can't|will not|won't|shall not)\b~30~\b(?:bring|join|participate in|take part in|be part of|act as)\b~30~\b(?:class|collective|representative)[- ](?:action|arbitration|proceeding|lawsuit)s?\b",
    )),
    ("class_action_kept", "Class actions kept", "you", "high", 70, "", None, None, (
        r"\b(?:nothing\b~40~\b(?:prevents?|stops?|restricts?|limits?|prohibits?)|(?:does|do|will|shall) not (?:prevent|stop|restrict|limit|prohibit|waive))\b~50~\b(?:class|collective|group|representative)[- ](?:action|claim|lawsuit|proceeding)s?\b",
    )),
    ("jury_waiver", "Jury-trial waiver", "them", "high", 85, "negatable", None, None, (
        r"\b(?:waive|waives|waiving|give up|giving up|waiver of)\b~60~\b(?:trial by (?:a )?jury|jury trials?)\b",
        r"\b(?:trial by (?:a )?jury|jury trials?)\b~30~\b(?:is|are) (?:hereby )?waived\b",
    )),
    ("release", "You give up claims", "them", "high", 70, "negatable", None, None, (
        r"\b(?:waive|waives|release|releases|give up|relinquish|discharge)\b~40~\b(?:any|all|every) (?:claims?|rights? to (?:sue|claim|recover)|causes? of action|demands)\b~tail~",
        r"\brelease\w* (?:us|~they~)\b~30~\bfrom\b~20~\b(?:any|all) (?:claims?|liability|demands)\b~tail~",
    )),
    ("arbitration_opt_out", "Arbitration opt-out", "you", "high", 60, "negatable", None, None, (
        r"\bopt(?:-| )?out of (?:this |the |these )?(?:binding )?arbitration(?: agreement| provision| clause)?\b~tail~",
        r"\breject (?:this |the )?arbitration (?:agreement|provision|clause)\b",
    )),
    ("time_limit", "Short time to claim", "them", "high", 55, "negatable", None, None, (
        r"\b(?:must|shall) be (?:brought|filed|commenced|made|started)\b~30~\bwithin ~number~ (?:years?|months?|days)\b",
        r"\b(?:claims?|causes? of action|actions?|disputes?)\b~80~\bwithin ~number~ (?:years?|months?)\b~50~\b(?:barred|waived|lost|time-barred|forever)\b",
        r"\b(?:is|are|will be|shall be) (?:permanently |forever )?(?:time-)?barred\b",
    )),
    ("venue", "Their choice of court", "them", "medium", 45, "", None, None, (
        r"(?<!non-)(?<!non )\b(?:exclusive|sole) (?:jurisdiction|venue)\b~100~\bcourts?\b~tail~",
        r"\bcourts?\b~60~\b(?:will|shall) have (?:exclusive |sole )?jurisdiction\b",
        r"\b(?:submit|consent|agree)\b~20~\bto the (?:exclusive |personal |sole )+jurisdiction\b~tail~",
        r"\b(?:resolved|heard|decided|brought|litigated)\b~20~\b(?:exclusively|only|solely) (?:by|in|before) the courts?\b~tail~",
    )),
    ("local_courts", "Your local courts", "you", "high", 55, "negatable", None, None, (
        r"\b(?:courts?|claims?|proceedings)\b~40~\b(?:where you live|of your (?:country|state|place) of residence|where you are resident|in your (?:home )?(?:country|state))\b",
    )),
    ("small_claims", "Small claims kept", "you", "medium", 40, "negatable", None, None, (
        r"\b(?:in |to |use )?(?:a |the )?small[- ]claims? courts?\b~tail~",
    )),
    ("informal_first", "Try to settle first", "neutral", "medium", 30, "negatable", None, None, (
        r"\bbefore (?:starting|bringing|filing|commencing|you (?:start|bring|file))\b~40~\b(?:claim|dispute|proceedings?|arbitration|lawsuit|action)\b~60~\b(?:contact|notify|give us|try to resolve|informal\w*|negotiat\w*)\b",
    )),
    ("governing_law", "Governing law", "neutral", "high", 30, "", None, None, (
        r"\bgoverned by\b~40~\blaws? of\b[^.;,\n]{1,60}",
        r"\bgoverned by\b[^.;,\n]{1,40}\blaws?\b",
        r"\blaws? of\b[^.;,\n]{1,50}\b(?:govern|governs|apply|applies|will apply|shall apply)\b",
    )),
    ("terms_changes", "They can change the terms", "them", "medium", 70, "negatable", r"\bat any time\b|\bsole discretion\b|\bwithout (?:prior )?notice\b|\bby posting\b", None, (
        r"\b~they~\b~30~\b(?:may|can|reserves? the right to|will)\b~30~\b(?:change|modify|amend|update|revise|replace)\b~30~\b(?:these|this|the|our|its) (?:terms|agreement|policy|policies|conditions|contract)\b",
        r"\b(?:these|this|the) (?:terms|agreement|conditions)\b~30~\b(?:may|can|will) be (?:changed|modified|amended|updated|revised)\b",
    )),
    ("continued_use", "Acceptance by carrying on", "them", "high", 65, "negatable", None, None, (
        r"\b(?:continued|continuing|further) (?:use|access)\b~80~\b(?:constitutes|means|signifies|indicates|shows|confirms|counts as|is deemed|will be deemed|will be treated as|amounts to)\b~30~\b(?:acceptance|accept|agree|agreement|consent)\w*",
        r"\bby (?:continuing to|continuing|keeping on) (?:use|using|access|accessing)\b~60~\byou (?:agree|accept|consent)\w*",
        r"\bif you (?:continue|keep) (?:to use|using)\b~60~\byou (?:agree|accept|are deemed|will be deemed)\w*",
    )),
    ("changes_need_consent", "Changes need your agreement", "you", "high", 65, "", None, None, (
        r"\b(?:not|never)\b~30~\b(?:change|modify|amend)\w*\b~40~\bwithout your (?:express |explicit |written )?(?:consent|agreement|permission)\b",
    )),
    ("advance_notice", "Advance notice", "you", "medium", 35, "negatable", None, None, (
        r"\b(?:notify|tell|email|inform|remind|warn|give) you\b~40~\b(?:at least )?~number~ (?:days|weeks|months)(?:'|’)?(?: (?:notice|before|in advance|prior))?",
        r"\b(?:at least )?~number~ (?:days|weeks|months)(?:'|’)? (?:prior |advance )?(?:written )?notice\b",
        r"\b(?:notify|tell|inform|email|warn) you\b~30~\b(?:before|in advance|beforehand)\b",
    )),
    ("termination", "They can close your account", "them", "medium", 75, "negatable not_you", r"\bat any time\b|\bfor any (?:or no )?reason\b|\bwithout (?:prior )?(?:notice|cause|reason)\b|\bsole discretion\b", None, (
        r"\b~they~\b~30~\b(?:may|can|reserves? the right to|(?:is|are) entitled to)\b~30~\b(?:suspend|terminate|close|disable|deactivate|ban|block|end|cancel|restrict|delete|refuse (?:service|access))\b~80~\b~at_will~",
        r"\b(?:suspend|terminate|close|disable|deactivate)\w*\b~60~\b(?:in (?:our|its) (?:sole|absolute) discretion|for any (?:or no )?reason|without (?:prior )?(?:notice|cause|reason))",
        r"\b(?:accounts?|files|content|data|profiles?)\b~60~\b(?:may|can|will) be (?:deleted|closed|suspended|terminated|removed|disabled)\b~tail~",
    )),
    ("service_changes", "They can change or stop the service", "them", "medium", 45, "negatable not_you", None, None, (
        r"\b(?:may|can|reserves? the right to)\b~20~\b(?:modify|change|suspend|discontinue|stop|withdraw|remove|reduce|limit)\b~50~\b(?:service|services|app|platform|features?|functionality|storage|products?)\b~40~\b(?:at any time|from time to time|without (?:prior )?notice|for any reason|in (?:our|its) (?:sole )?discretion)",
        r"\b(?:may|can) be (?:withdrawn|changed|modified|discontinued|cancell?ed|revoked|removed)\b~20~\b(?:at any time|without (?:prior |advance )?notice|for any reason)",
        r"\bnot (?:obliged|obligated|required|bound) to (?:keep |continue )?(?:support|provid|maintain|offer|updat)\w*~tail~",
        (r"\b(?:discontinue|shut down|stop (?:offering|providing))\b~30~\b(?:the |any |our )?(?:service|services|app)\b", "low"),
    )),
    ("remove_content", "They can remove your content", "them", "medium", 40, "negatable not_you", None, None, (
        r"\b(?:may|can|reserves? the right to)\b~20~\b(?:remove|delete|take down|disable|refuse|block|edit)\b~40~\b(?:content|posts?|files?|material|reviews?|listings?|comments?|uploads?)\b~60~\b(?:at any time|for any (?:or no )?reason|without (?:prior )?notice|in (?:our|its) (?:sole|absolute) discretion|that (?:we|it) (?:believe|consider|think|decide)s?)",
    )),
    ("assignment", "They can pass the contract on", "them", "low", 25, "negatable", None, None, (
        r"\b~they~\b~20~\b(?:may|can)\b~15~\b(?:assign|transfer)\b~40~\b(?:these terms|this agreement|the agreement|our rights|its rights|our obligations)\b",
    )),
    ("you_cancel", "You can leave any time", "you", "high", 50, "negatable", None, None, (
        r"\byou (?:can|may|are free to)\b~30~\b(?:cancel|close|terminate|end|stop using|leave|delete (?:your )?account)\b~60~\b(?:at any time|any ?time|whenever you (?:like|want|wish)|for any reason|free of charge|at no (?:extra )?(?:cost|charge))",
    )),
    ("mutual_termination", "Either side can end it", "neutral", "medium", 30, "negatable", None, None, (
        r"\beither (?:party|of us)\b~30~\b(?:may|can)\b~20~\b(?:terminate|end|cancel)\b~tail~",
    )),
    ("auto_renewal", "Automatic renewal", "them", "medium", 60, "negatable", r"\bthen[- ]current (?:price|rate|fee)|\bunless you cancel\b|\buntil you cancel\b", None, (
        r"\b(?:renews?|renewed|renewal|extends?|extended|continues?|converts?)\b~30~\bautomatically\b",
        r"\bautomatic(?:ally)?(?:[- ]renew\w*| (?:renew\w*|extend\w*|convert\w*|charged?|billed|bill\w*))\b",
        r"\bauto[- ]?renew\w*\b",
        r"\b(?:continues?|renews?|billed|charged)\b~30~\buntil you cancel\b",
        (r"\b(?:recurring|continuous) (?:billing|charges?|payments?|subscription)\b", "low"),
    )),
    ("price_changes", "They can raise prices", "them", "medium", 50, "negatable not_you", r"\bat any time\b|\bwithout (?:prior |advance )?notice\b", None, (
        r"\b(?:may|can|reserves? the right to)\b~20~\b(?:change|increase|raise|adjust|modify)\b~20~\b(?:fees?|prices?|pricing|charges|rates)\b~tail~",
        r"\bat the then[- ]current (?:price|rate|fee)s?\b",
        r"\b(?:fees?|prices?|pricing)\b~20~\b(?:may|can|are subject to|is subject to) (?:change|increase)\b",
    )),
    ("no_refunds", "No refunds", "them", "high", 60, "", None, None, (
        r"\b(?:is|are|will be|shall be)\s+(?:strictly\s+|entirely\s+|completely\s+|final and\s+)?non-?refundable\b~tail~",
        r"\bno refunds?\b~tail~",
        r"\brefunds?\b~20~\b(?:is|are|will|shall)\s+not\s+(?:be\s+)?(?:given|available|provided|issued|offered|made|due)\b",
        r"\b(?:do not|don't|will not|won't) (?:offer|give|provide|issue) refunds?\b",
        r"\b(?:cannot|can't|can not|will not|won't|shall not|are not|is not) be refunded\b",
        r"\b(?:is|are) not refundable\b",
        (r"\brefunds?\b~40~\b(?:at|in) (?:our|its) (?:sole |absolute )?discretion\b", "medium"),
    )),
    ("extra_fees", "Extra charges", "them", "medium", 45, "negatable", None, None, (
        (r"\b(?:late|cancellation|termination|early termination|service|demand|processing|administration|admin|restocking|surge|convenience|inactivity) (?:fees?|charges?)\b", "low"),
        r"\b(?:may|will|shall) be charged (?:in full|the full (?:amount|price))\b",
        r"\binterest (?:at|of) (?:[\d.]+ ?(?:%|percent))",
    )),
    ("expiring_credit", "Credit that expires", "them", "medium", 40, "", None, None, (
        r"\b(?:credits?|balances?|points|vouchers?|gift cards?|virtual (?:currency|items|goods)|coins|tokens)\b~40~\b(?:expires?|expire after|lapses?|forfeit\w*|(?:has|have) no (?:cash|monetary|real-world) value|cannot be (?:exchanged|redeemed|converted) for cash|non-transferable)\b~tail~",
    )),
    ("refund_right", "Refunds", "you", "high", 55, "negatable", None, None, (
        r"\b(?:we will|we'll|we shall|you will (?:get|receive)|you (?:can|may) (?:get|receive|claim|request|ask for))\b~30~\b(?:a )?(?:full |pro[- ]?rata |prorated |partial )?refund\w*\b~tail~",
        r"\bfor a (?:full |pro[- ]?rata |prorated |partial )refund\b",
        r"\b(?:money[- ]back|refund) guarantee\b",
        r"\b(?:we will|we'll) refund\b~tail~",
    )),
    ("liability_cap", "Liability cap", "them", "high", 70, "", None, None, (
        r"\b(?:total|aggregate|maximum|entire|cumulative|combined|whole) liability\b~160~\b(?:(?:shall|will|does|may|won't) not exceed|(?:is|are|be|will be|shall be) (?:limited|capped) (?:to|at)|limited to|not to exceed)~tail~",
        r"\bliability\b~60~\b(?:is|are|be|will be|shall be) limited to (?:the )?(?:greater|lesser|amount|fees?|sum|total|price)~tail~",
    )),
    ("no_liability", "Not responsible", "them", "medium", 65, "not_you", r"\bindirect\b|\bconsequential\b|\bincidental\b|\bpunitive\b|\bany (?:loss|damage|injury)\b|\blost profits\b|\bloss of (?:data|profits?|revenue)\b", None, (
        r"\b(?:in no event|under no circumstances)\b~100~\b(?:be )?(?:liable|responsible)\b~tail~",
        r"\b~they~\b~30~\b(?:(?:are|is|will|shall|can|do|does) not|won't|isn't|aren't|cannot|can't|never)\s+(?:be\s+|accept\s+|take\s+)?(?:held\s+)?(?:liable|responsible|liability|responsibility)\b~tail~",
        r"\bnot (?:be )?(?:liable|responsible) for (?:any )?(?:indirect|incidental|special|consequential|punitive|exemplary|lost|loss)\w*~tail~",
        r"\b(?:disclaim|exclude)s?\b~30~\b(?:all |any )?liability\b",
        r"\b(?:your )?(?:sole|exclusive|only) (?:and exclusive )?remedy\b~tail~",
    )),
    ("no_warranty", "No promises it works", "them", "medium", 50, "", None, None, (
        r"\b(?:provided|offered|made available|supplied)\b~10~(?:on an )?[\"“']?as[- ]is[\"”']?(?:,? (?:and|or) [\"“']?as[- ]available[\"”']?)?",
        r"\bwithout (?:any )?(?:warranty|warranties|guarantees?)(?: of any kind)?\b",
        r"\b(?:disclaim|exclude)s?\b~30~\b(?:all |any )?(?:warranties|guarantees|conditions)\b",
        r"\b(?:make|makes|give|gives) no (?:warranties|warranty|guarantees?|promises|representations)\b",
        r"\b(?:do not|does not|don't|doesn't|cannot|can't|can not) (?:guarantee|warrant|promise)\b~tail~",
        r"\b(?:are|is) (?:only )?(?:estimates|approximate|approximations|indicative)(?: only)?\b",
        r"\bmay (?:be|contain|include) (?:inaccura\w+|incomplete|errors|out of date|out-of-date)\b",
        r"\bnot (?:a |an )?(?:medical|legal|financial|professional|investment|tax) (?:advice|device|adviser|advisor)\b",
    )),
    ("warranty", "A warranty for you", "you", "medium", 50, "negatable", None, None, (
        r"\b(?:limited |full |manufacturer'?s? )?(?:warranty|guarantee) (?:against|for|covering) (?:defects|faults)\b~tail~",
        r"\b(?:we|~they~) (?:will|shall) (?:repair|replace)\b~tail~",
    )),
    ("accepts_liability", "They accept some responsibility", "you", "medium", 45, "negatable", None, None, (
        r"\b~they~\b~20~\b(?:are|is|will be|shall be|remain|remains)\s+(?:fully\s+)?(?:liable|responsible)\s+for\b~tail~",
    )),
    ("rights_kept", "Rights the law protects", "you", "high", 60, "", None, None, (
        r"\bnothing in (?:these|this|the)\b~60~\b(?:limits?|excludes?|restricts?|affects?|removes?|reduces?)\b~60~\b(?:liability|rights?)\b",
        r"\b(?:does|do|will|shall) not (?:affect|limit|exclude|restrict|reduce)\b~40~\byour (?:statutory |legal |consumer |mandatory )?rights\b",
        r"\b(?:in addition to|without prejudice to)\b~30~\b(?:any )?(?:statutory |legal |consumer )?rights you (?:have|may have)\b",
        r"\byour (?:statutory |legal |consumer |mandatory )?rights\b~20~\b(?:are|is|remain) (?:not affected|unaffected)\b",
    )),
    ("indemnity", "You cover their costs", "them", "high", 80, "negatable", None, None, (
        r"\b(?:you|users?|customers?|members?|subscribers?)\s+(?:(?:hereby|also|further)\s+)?(?:agree|agrees|will|shall|must|undertake|undertakes|are required|consent)(?:\s+to)?\s+(?:\w+\s+){0,2}?(?:indemnify|defend|hold\b~40~\bharmless|reimburse)\b~tail~",
        r"\b(?:indemnify|defend|hold harmless)\b~20~\b(?:us|~they~)\b~tail~",
    )),
    ("they_indemnify", "They cover your costs", "you", "high", 75, "negatable", None, None, (
        r"\b~they~\b~30~\b(?:will|shall|agrees? to|undertakes? to)\s+(?:\w+\s+){0,2}?(?:indemnify|defend|reimburse|compensate) you\b~tail~",
    )),
    ("account_risk", "You carry your account's risk", "them", "low", 25, "negatable", None, None, (
        r"\byou (?:are|will be|shall be|remain) (?:solely |fully |entirely )?responsible for\b~40~\b(?:all )?(?:activity|activities|use|actions|charges|conduct)\b~tail~",
    )),
    ("content_licence", "Licence to your content", "them", "medium", 80, "negatable", r"\bperpetual\b|\birrevocable\b|\bsub-?licens\w+|\btransferable\b|\broyalty[- ]free\b|\bworldwide\b|\badvertis\w+|\bpromot\w+", None, (
        r"\b(?:grant|grants|granting|give|gives)\s+(?:to\s+)?(?:us|~they~)\b~120~\b(?:licen[cs]e|rights?)\b~tail~",
        r"\b(?:licen[cs]e|right)\s+to\s+(?:use|host|store|reproduce|copy|modify|adapt|publish|distribute|display|sell|commerciali[sz]e)\b~80~\b(?:your |user |any )?(?:content|photos?|images?|videos?|posts?|reviews?|submissions?|materials?|uploads?|files?|feedback|likeness)\b",
    )),
    ("licence_survives", "Licence outlives your account", "them", "high", 70, "negatable", None, None, (
        r"\blicen[cs]e\b~40~\b(?:continues|survives|remains|lasts|continue|survive)\b~60~\bafter\b~40~\b(?:delete|close|terminat|remove|leave|end|cancel)\w*~tail~",
    )),
    ("you_own_content", "You keep ownership", "you", "high", 65, "", None, None, (
        r"\byou (?:retain|keep|own|continue to own|remain the owner of)\b~40~\b(?:ownership|rights?|title|intellectual property|content|files|data|photos|posts|everything)\b~tail~",
        r"\b(?:do|does|will) not (?:claim|take|acquire)\b~20~\bownership\b~tail~",
        r"\byour (?:content|files|data|photos|posts) (?:remains?|stays?|is|are) yours\b",
    )),
    ("app_licence", "Licence to use the app", "neutral", "medium", 20, "negatable", None, None, (
        r"\b~they~\b~20~\bgrants?\s+you\b~80~\blicen[cs]e\b~tail~",
    )),
    ("data_sale", "Selling your data", "them", "high", 85, "negatable", None, None, (
        r"\b(?:sell|sells|selling|rent|rents|renting|trade|trades|monetise|monetize)\b~40~\b(?:your |the )?~data~",
        r"\b~data~\b~40~\b(?:may|can|will|might) be (?:sold|rented|traded|licensed)\b",
    )),
    ("no_data_sale", "They do not sell your data", "you", "high", 80, "", None, None, (
        r"\b(?:do|does|will|shall) not (?:and will not )?(?:sell|rent|trade)\b~40~\b(?:your |the )?~data~",
        r"\b(?:never|won't|don't|doesn't) (?:sell|rent|trade)\b~40~\b(?:data|information|details)\b",
        r"\b(?:is|are) never (?:sold|rented)\b",
    )),
    ("data_sharing", "Sharing your data", "them", "medium", 75, "negatable", r"\badvertis\w*|\bmarketing\b|\bdata brokers?\b|\binsurers?\b|\bemployers?\b", r"^(?!.*\b(?:advertis|marketing|data broker|insurer|employer))(?=.*\b(?:service providers?|processors?|on (?:our|its) behalf)\b)", (
        r"\b(?:share|shares|sharing|disclose|discloses|transfer|transfers|provide|provides|pass|passes)\b~60~\b~data~\b~80~\b~parties~\b~tail~",
        r"\b~data~\b~40~\b(?:may be |is |are |will be )?(?:shared with|disclosed to|transferred to|sold to|passed to|made available to)\b~50~\b~parties~\b",
    )),
    ("data_processors", "Data shared to run the service", "neutral", "medium", 30, "negatable", None, None, (
        r"\b(?:share|shares|disclose|provide|pass|give)\w*\b~80~\b(?:service providers?|processors?|contractors|vendors|suppliers)\b~tail~",
        r"\b(?:share|shares|disclose|provide|pass|give)\w*\b~80~\b(?:for your order|to (?:deliver|fulfil|fulfill|complete|process) (?:your |the )?(?:order|delivery|payment)s?)\b",
    )),
    ("deidentified", "Data they say is anonymous", "unclear", "medium", 35, "negatable", None, None, (
        r"\b(?:aggregated|de-?identified|anonymi[sz]ed|pseudonymi[sz]ed)\b~40~\b(?:data|information|form|results|statistics|insights|reports)\b~tail~",
    )),
    ("ai_training", "Your content trains their AI", "them", "medium", 70, "negatable", None, r"\b(?:never|not|won't|don't|doesn't)\s+(?:\w+\s+){0,2}(?:use|share|allow|permit)\b~60~\btrain", (
        r"\b(?:use|uses|using)\b~80~\b(?:content|files|data|messages|photos|posts|uploads|conversations)\b~60~\bto (?:train|develop|build|improve)\b~40~\b(?:models?|AI|artificial intelligence|machine[- ]learning|algorithms?|automated (?:features|systems|tools))\b",
        r"\b(?:train|training)\b~40~\b(?:machine[- ]learning|artificial intelligence|AI|language) models?\b",
    )),
    ("no_ai_training", "No AI training on your content", "you", "high", 70, "", None, None, (
        r"\b(?:never|not|won't|don't|doesn't)\s+(?:\w+\s+){0,2}(?:use|share|allow|permit)\b~60~\btrain\w*\b~40~\b(?:models?|AI|artificial intelligence|machine[- ]learning|algorithms?)\b",
    )),
    ("tracking", "Tracking and targeted ads", "them", "medium", 50, "negatable", None, None, (
        r"\b(?:targeted|personali[sz]ed|interest[- ]based|behaviou?ral|tailored) (?:ads|advertising|advertisements|adverts|marketing)\b",
        r"\b(?:use|uses|place|places|set|sets)\b~30~\b(?:cookies|web beacons|pixels?|tracking technologies|similar technologies|device identifiers|advertising ids?)\b~tail~",
        r"\b(?:use|uses|analy[sz]e)\b~40~\b(?:order history|browsing|activity|behaviou?r|purchases|usage)\b~40~\b(?:to (?:show|send|serve|target|personali[sz]e)|for)\b~20~\b(?:ads|advertising|advertisements|adverts|marketing|recommendations)\b",
        r"\btrack\w*\b~40~\bacross (?:other )?(?:sites|websites|apps|services)\b",
        r"\b(?:use|uses|analy[sz]e)\b~40~\b(?:data|history|activity|behaviou?r|purchases|usage)\b~40~\bto (?:show|send|serve|target|personali[sz]e|tailor)\b~30~\b(?:ads|advertising|advertisements|adverts|marketing|offers|promotions)\b~tail~",
    )),
    ("marketing_consent", "Marketing messages", "them", "medium", 40, "negatable", None, None, (
        r"\byou (?:agree|consent) to receive\b~40~\b(?:marketing|promotional|commercial|advertising|offers|text messages|SMS|calls)\b~tail~",
    )),
    ("opt_out", "You can opt out", "you", "high", 55, "negatable", None, r"\bopt(?:-| )?out of (?:this |the |these )?(?:binding )?arbitration", (
        r"\byou (?:can|may|are able to|have the right to)\b~20~\b(?:opt[- ]out|turn off|switch off|disable|withdraw (?:your )?consent|unsubscribe|object)\b~tail~",
        r"\b(?:opt[- ]out|unsubscribe)\b~30~\b(?:at any time|any ?time)\b",
    )),
    ("data_rights", "Your data rights", "you", "high", 55, "negatable", None, None, (
        r"\byou (?:can|may|have the right to|are entitled to)\b~20~\b(?:request |ask (?:us )?to )?(?:export|download|port)\b~tail~",
        r"\byou (?:can|may|have the right to|are entitled to)\b~20~\b(?:request |ask (?:us )?to )?(?:delete|erase|access|correct|obtain|receive)\b~40~\b(?:data|information|files|content|copy|notes|photos|messages|documents|history)\b~tail~",
        r"\bright to (?:access|delete|erase|export|correct|port|object)\b~tail~",
        r"\b(?:we will|we'll) (?:delete|erase|export)\b~40~\b(?:data|information|files)\b~tail~",
    )),
    ("age_limit", "Age limit", "neutral", "high", 20, "", None, None, (
        r"\b(?:at least|over|under|below|older than|younger than|aged)\s+(?:the age of\s+)?\d{1,2}(?:\s+years?[- ](?:old|of age)|\+|\s+or (?:older|over))",
        r"\b(?:the )?age of (?:\d{1,2}|majority|eighteen|sixteen|thirteen)\b",
        r"\b(?:must|need to|have to) be (?:at least )?(?:\d{1,2}|eighteen|sixteen|thirteen)(?: or (?:older|over))?\b",
        r"\bparent(?:al)?(?: or (?:legal )?guardian(?:'s)?)? (?:consent|permission|supervision)\b",
    )),
)

# Who counts as the company, and which words are not its name.
OWN_WORDS = frozenset(("we", "us", "our"))
NOT_A_PARTY = frozenset((
    "you", "your", "user", "users", "customer", "customers", "member", "members", "subscriber", "terms", "agreement", "service", "services", "app", "apps", "site", "website", "platform", "content",
    "account", "privacy notice", "privacy policy", "policy", "data", "health data", "personal data", "company", "the company", "software", "product", "products",
))
COMPANY_FORMS = r"inc|ltd|llc|l\.l\.c|limited|corp|corporation|gmbh|ag|s\.a|sas|b\.v|plc|co|pty|llp|company"

# Words that negate, and words that a quote should not end on.
NEGATORS = frozenset(("not", "never", "no", "nor", "neither", "without", "cannot", "nothing", "none"))
INNER_NEGATORS = frozenset(("not", "never", "cannot"))
FUNCTION_WORDS = frozenset(
    "a an and or but nor the to of in on at by for from with as that which who than is are be into onto about under over per via any all each its their your our this these those if when where".split()
)

#: What a label means to the person who agrees, in one line, by rule.
# What a word is, how a company and the reader are named, and which marks a quote doesn't begin, end or run on with.
WORDS = re.compile(r"[a-z’']+", re.IGNORECASE)
DEFINITION = re.compile(r"\(([^()\n]{1,160})\)")
QUOTED = re.compile(r"[\"“”]([^\"“”\n]{1,40})[\"“”]")
READER = re.compile(r"\byou\s+(?:[a-z]+\s+){0,2}$", re.IGNORECASE)
EDGE_MARKS, END_MARKS, CLOSING = ",;:-)", ",;:-(“‘", " .;:!?\"'”’)"
UNLIKE_REST = re.compile(r"[.,;!?\n]")

READINGS = {
    "arbitration": "A private arbitrator, not a court, settles disputes for good.",
    "class_waiver": "Claims can only be made alone, never together with others.",
    "class_action_kept": "Joining a group claim stays possible.",
    "jury_waiver": "No jury will decide a dispute.",
    "release": "Claims that could otherwise be brought are given up.",
    "arbitration_opt_out": "Arbitration can be declined in time, which keeps the way to court open.",
    "time_limit": "A claim is lost unless it is made within a short time.",
    "venue": "The company picks the courts, wherever these are.",
    "local_courts": "Claims can be brought in the courts near home.",
    "small_claims": "A small-claims court remains open for small disputes.",
    "informal_first": "A problem has to be raised informally before a formal claim.",
    "governing_law": "Names the law that applies.",
    "terms_changes": "The company can rewrite these terms on its own.",
    "continued_use": "Carrying on after a change counts as agreeing to it.",
    "changes_need_consent": "Terms cannot change without agreement.",
    "advance_notice": "A change is announced before it takes effect.",
    "termination": "The company can close or suspend an account as it sees fit.",
    "service_changes": "The service or parts of it can change or end.",
    "remove_content": "The company can take uploads down on its own judgement.",
    "assignment": "The contract can be handed to another company.",
    "you_cancel": "Leaving is possible whenever wanted.",
    "mutual_termination": "Both sides can end the agreement.",
    "auto_renewal": "Charges go on by themselves until cancelled.",
    "price_changes": "Prices can go up.",
    "no_refunds": "Money paid does not come back.",
    "extra_fees": "More than the stated price may be due.",
    "expiring_credit": "Credit can lapse or cannot be paid out.",
    "refund_right": "Money can be had back in the cases described.",
    "liability_cap": "Compensation is limited to a fixed amount.",
    "no_liability": "The company declines responsibility for certain losses.",
    "no_warranty": "No promise that the service works, is right or fits.",
    "warranty": "A promise of quality, with repair or replacement.",
    "accepts_liability": "The company takes responsibility for some losses.",
    "rights_kept": "Rights that the law grants stay in place.",
    "indemnity": "The user pays when the company is sued over what the user did.",
    "they_indemnify": "The company pays when the user is sued over the service.",
    "account_risk": "The user answers for all that happens in the account.",
    "content_licence": "The company may use what is uploaded.",
    "licence_survives": "That permission lasts after content or account are gone.",
    "you_own_content": "Uploads stay the user's own.",
    "app_licence": "Permission to use the service, on its terms.",
    "data_sale": "Personal information may be sold or rented out.",
    "no_data_sale": "Personal information is not sold.",
    "data_sharing": "Personal information may go to other companies.",
    "data_processors": "Companies that help run the service get data.",
    "deidentified": "Data said to be anonymous is used or shared; whether it is depends on the method.",
    "ai_training": "Content or data may train automated systems.",
    "no_ai_training": "Content and data do not train models.",
    "tracking": "Behaviour is followed and may steer advertising.",
    "marketing_consent": "Agreeing means receiving marketing.",
    "opt_out": "This can be switched off.",
    "data_rights": "Data can be copied out or deleted on request.",
    "age_limit": "Sets a least age.",
}
