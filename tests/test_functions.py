import re
import time

import pytest
from clausemill.functions import text as tx
from clausemill.functions.canonical import canonical, fingerprint, with_canonical
from clausemill.functions.clauses import LONG, is_heading, is_inline_title, segments
from clausemill.functions.findings import Clauses, clipped, company_names, expand, findings, needed_literals, negated_before, place_quote, read, reader_before, rules, tidy
from pyspark.sql import functions as F

NBSP, ZW, LS, PS = chr(160), chr(0x200B), chr(0x2028), chr(0x2029)
RAW = {
    "a\r\nb\rc\n": "a\nb\nc".replace("\nb\nc", " b c"),
    "One.\r\nTwo.\rThree.": "One.\nTwo.\nThree.",
    "A.\fB." + LS + "C." + PS + "D.": "A.\n\nB.\nC.\n\nD.",
    "e" + chr(0x301) + "x": chr(0xE9) + "x",
    "a\x00b\x07c\x7fd": "abcd",
    f"a{ZW}b{chr(0xFEFF)}c{chr(0xAD)}d": "abcd",
    f" a{NBSP}\t{chr(0x3000)}b \n  c d. ": "a b c d.",
    "the fee is\npaid monthly": "the fee is paid monthly",
    "list:\na. first\nb) second\niv. fourth": "list:\na. first\nb) second\niv. fourth",
    "end.\nnext": "end.\nnext",
    "A\n\n\n\nB": "A\n\nB",
    "\x85 x " + NBSP: "x",
    "": "",
}


@pytest.mark.parametrize("raw", RAW)
def test_canonical(raw):
    assert canonical(raw) == RAW[raw] and canonical(canonical(raw)) == canonical(raw)


@pytest.mark.parametrize("native", [False, True])
def test_canonical_columns_agree(spark, native):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*RAW, None])], "doc_id long, text string")
    got = {r.doc_id: r for r in with_canonical(df, native=native).withColumn("key", fingerprint(F.col("text"))).collect()}
    for i, (raw, want) in enumerate(RAW.items()):
        assert got[i].text == want, repr(raw)
    assert got[len(RAW)].text is None
    assert spark.range(1).select(fingerprint(F.lit("abc"))).first()[0].startswith("ba7816bf")


def bodies(text):
    return [text[s.start : s.end] for s in segments(text)]


def test_headings():
    for line in ("# Any thing", "TERMS OF USE", "1. Your Account", "Section 2 Payment and Billing", "What We Collect"):
        assert is_heading(line), line
    for line in ("We collect data.", "your account", "TERMS;", "This is what happens here", "Definitions:", "123", "", "A " * 60):
        assert not is_heading(line), line


def test_sentences_and_abbreviations():
    assert bodies("You may call Acme Inc. Support any day. Mr. Smith of the U.S. Office helps with No. 5 forms.") == ["You may call Acme Inc. Support any day.", "Mr. Smith of the U.S. Office helps with No. 5 forms."]
    assert bodies("4. You may leave at any time. (We may not object to it.)") == ["4. You may leave at any time.", "(We may not object to it.)"]
    assert bodies('He said "we agree." Then everyone left the room.') == ['He said "we agree."', "Then everyone left the room."]
    assert bodies("You agree not to: (a) copy the app; (b) sell the app; and (c) break the app.") == ["You agree not to: (a) copy the app;", "(b) sell the app;", "and (c) break the app."]


def test_titles_and_short_pieces():
    assert is_inline_title("1. Acceptance.") and is_inline_title("Governing Law.") and not is_inline_title("We accept this now.") and not is_inline_title("Fees")
    assert bodies("Fees. You pay each month in advance.") == ["Fees. You pay each month in advance."]
    assert bodies("Yes. We do keep all of the records for years. No.") == ["Yes. We do keep all of the records for years. No."]
    assert bodies("No.") == ["No."]


def test_long_clauses_are_cut_at_semicolons():
    text = "x " * 200 + "a; " + "y " * 200 + "b; " + "z " * 200 + "end."
    parts = segments(text)
    assert len(parts) > 1 and all(p.end - p.start <= LONG for p in parts)
    assert bodies("w" * 2000) == ["w" * 2000]


def test_segments_cover_and_number():
    text = canonical("TERMS\n\nWe do this. You do that; (a) one thing now; or (b) another thing.\n\n2. Next Part\nA lone line without end\n" + "word " * 400)
    parts = segments(text)
    assert [p.id for p in parts if p.kind == "clause"] == list(range(1, sum(p.kind == "clause" for p in parts) + 1))
    covered = set()
    for a, b in zip(parts, parts[1:]):
        assert a.end <= b.start
    for p in parts:
        assert "\n" not in text[p.start : p.end] and text[p.start : p.end] == text[p.start : p.end].strip()
        covered |= set(range(p.start, p.end))
    assert all(c.isspace() or i in covered for i, c in enumerate(text))


def test_segmentation_is_fast():
    for text in ("Pay now. " * 6600, "e.g. x. " * 7500, "." * 60_000, "Go. " * 15_000, '"' * 60_000, "a" * 60_000):
        t = time.perf_counter()
        segments(canonical(text))
        assert time.perf_counter() - t < 2, text[:10]


POSITIVE = {
    "arbitration": "Each dispute is decided by final arbitration.", "class_waiver": "You waive any part in a class action.", "class_action_kept": "Nothing in this text stops you joining a class action.",
    "jury_waiver": "Both of us give up the right to a jury trial.", "release": "You release any claims against the site.", "arbitration_opt_out": "You can opt out of arbitration by letter.",
    "time_limit": "Every suit must be filed within one year of the event.", "venue": "The exclusive jurisdiction lies with the courts of Delmar.", "local_courts": "You can bring claims where you live.",
    "small_claims": "A small claims court can hear the matter.", "informal_first": "Before filing a claim, please contact our team.", "governing_law": "This text is governed by the laws of Norway.",
    "terms_changes": "We may change these terms.", "continued_use": "Continued use of the app means acceptance of them.", "changes_need_consent": "We will never change the plan without your consent.",
    "advance_notice": "We will email you 14 days before that.", "termination": "We may close your account at any time.", "service_changes": "We may discontinue the service at any time.",
    "remove_content": "We may remove posts at any time.", "assignment": "We may transfer this agreement.", "you_cancel": "You may cancel at any time.", "mutual_termination": "Either party may end the contract by letter.",
    "auto_renewal": "The plan renews automatically.", "price_changes": "We may raise prices each spring.", "no_refunds": "There are no refunds.", "extra_fees": "A late fee is due.",
    "expiring_credit": "Points expire after a year.", "refund_right": "We will refund the price.", "liability_cap": "Our total liability shall not exceed ten dollars.", "no_liability": "In no event are we liable.",
    "no_warranty": "It is provided as is.", "warranty": "There is a warranty against defects.", "accepts_liability": "We are responsible for our own faults.", "rights_kept": "Nothing in these terms limits your rights.",
    "indemnity": "You agree to indemnify the firm.", "they_indemnify": "We will reimburse you for legal costs.", "account_risk": "You are responsible for all activity.", "content_licence": "You grant us a licence to it.",
    "licence_survives": "The licence continues after you delete the post.", "you_own_content": "You keep ownership of it.", "app_licence": "We grant you a limited licence.", "data_sale": "We sell your data.",
    "no_data_sale": "We do not sell your data.", "data_sharing": "We share your data with advertisers.", "data_processors": "We share it with service providers.", "deidentified": "We publish aggregated statistics.",
    "ai_training": "We use messages to train models.", "no_ai_training": "We never use chats to train models.", "tracking": "We show targeted ads.", "marketing_consent": "You agree to receive marketing.",
    "opt_out": "You can opt out here.", "data_rights": "You can export it.", "age_limit": "You must be 18.",
}
NEAR_MISS = {
    "terms_changes": "We will not change these terms.", "termination": "You may close your account at any time.", "data_sale": "We do not sell your personal information.", "class_waiver": "Nothing here prevents you from joining a class action or waives a class action.",
    "venue": "Courts may take non-exclusive jurisdiction.", "auto_renewal": "Your plan is never renewed automatically.", "data_sharing": "We share your data with partners who are service providers.", "opt_out": "You can opt out of this arbitration agreement.",
    "ai_training": "We will never use your files to train AI models.", "price_changes": "You may change prices in your own shop.", "arbitration": "No claim is resolved by arbitration.", "no_liability": "You are not responsible for this.",
}


def found(text):
    text = canonical(text)
    return {f.rule.id: f for fs in findings(text, segments(text)) for f in fs}


def all_found(sentence):
    """Rules of any rank: findings() keeps four of a clause."""
    return set(found(sentence))


@pytest.mark.parametrize("rule", [r.id for r in rules()])
def test_each_rule_fires(rule):
    assert rule in all_found(POSITIVE[rule]), (POSITIVE[rule], all_found(POSITIVE[rule]))


@pytest.mark.parametrize("rule", NEAR_MISS)
def test_near_misses(rule):
    assert rule not in all_found(NEAR_MISS[rule])


def test_confidence_and_rank():
    got = found("You agree to binding arbitration; a late fee applies.")
    assert got["arbitration"].confidence == "high" and got["extra_fees"].confidence == "low"
    text = "We may change these terms and raise prices at any time, and you waive any class action."
    first = findings(text, segments(text))[0]
    assert [f.rule.id for f in first][:2] == ["class_waiver", "terms_changes"] and len(first) <= 4


def test_company_names():
    assert company_names('Velo Ltd. ("Velo") runs it. The site ("Service").') == ("Velo",)
    assert company_names('Orm House ("Orm", "we" or "us") and you ("User").') == ("Orm",)
    assert company_names('The plan ("Plan").') == ()
    got = found('Velo Ltd. ("Velo") runs this shop.\nVelo may suspend any account at any time.')
    assert "termination" in got
    assert "termination" not in found("Velo may suspend the plan soon.")


def test_literals_are_needed():
    for r in rules():
        for p, _ in r.patterns:
            literals = needed_literals(expand(p))
            m = re.search(expand(p), POSITIVE[r.id], re.IGNORECASE)
            assert literals and (not m or any(x in m[0].casefold() for x in literals))


def test_negation_and_subject():
    assert negated_before("we do not ever sell", len("we do not ever ")) and not negated_before("not now, we sell", len("not now, we "))
    assert not negated_before("not one two three four five six", len("not one two three four five "))
    assert negated_before("x" * 500 + " don’t sell", 500 + len(" don’t "))
    assert reader_before("then you may close", len("then you may ")) and reader_before("you can also close", len("you can also ")) and not reader_before("you and the firm may close", len("you and the firm may "))


def test_tidy():
    body = "Fees, which are strictly non-refundable, apply to all of the plans."
    s, e = tidy(body, body.index("refundable"), body.index("refundable") + 4)
    assert body[s:e] == "refundable, apply to all of the plans"
    s, e = tidy("There are no refunds, ever.", 10, 20)  # a mark right after a short match must not stop the widening
    assert "There are no refunds, ever."[s:e] == "no refunds, ever."
    body = 'It is "provided as is" here and there for everybody who asks for it.'
    s, e = tidy(body, 7, 22)
    assert body[s:e].count('"') % 2 == 0 or body[s:e].startswith('"')


def test_reading_is_verbatim_and_fast():
    text = canonical("TERMS\n" + "\n".join(POSITIVE.values()))
    out = read(text, segments(text))
    assert out["received"] == out["verified"] and not out["dropped"] and len(out["readings"]) >= 50
    clauses = Clauses(text, segments(text))
    for r in out["readings"]:
        own = clauses.numbered(r["id"])
        assert all(own.start <= f["quote_start"] < f["quote_end"] <= own.end for f in r["findings"])
    for hostile in ("you agree to binding arbitration we may change these terms " * 1000, "not share your data with " * 2400, "we may " * 8500):
        t = time.perf_counter()
        read(hostile, segments(hostile))
        assert time.perf_counter() - t < 5


def test_placing_quotes():
    text = "Alpha beta gamma delta. Epsilon zeta eta theta. Alpha beta gamma again."
    c = Clauses(text, segments(text))
    assert [p for p in place_quote(c, "Epsilon zeta eta", 2)] == [None, c.numbered(2), 24, False]
    assert place_quote(c, "Epsilon zeta eta", 1)[3] and place_quote(c, "Alpha beta gamma", 2)[0] == "ambiguous"
    assert place_quote(c, "no such words here", 1)[0] == "not_found" and place_quote(c, "beta", 1)[0] == "too_short" and place_quote(c, "delta. Epsilon zeta", 1)[0] == "crosses_clause"
    assert clipped("a  b\n c") == "a b c" and len(clipped("word " * 100)) <= 281 and clipped("word " * 100).endswith("word…")


def test_text_columns(spark):
    def one(column):
        return spark.range(1).select(column).first()[0]

    smile = chr(0x1F600)
    assert one(tx.code_points(F.lit("a" + smile))) == 2 and one(tx.utf16_index(F.lit("a" + smile + "b"), F.lit(2))) == 3 and one(tx.utf16_index(F.lit("ab"), F.lit(9))) == 2
    assert one(tx.prepared(F.lit(" a\r\nb\f\n\nc " + PS + "d "))) == "a\nb\n\nc \n\nd"
    assert one(tx.has_readable_text(F.lit(" " + ZW + NBSP))) is False and one(tx.has_readable_text(F.lit("x"))) is True
    assert one(tx.looks_like_html(F.lit("<p>a</p> <x"))) is True and one(tx.looks_like_html(F.lit("a < b"))) is False and one(tx.looks_like_html(F.lit("<p> <p"))) is False
    assert one(tx.model_name(F.lit("claude-abc-4-5"))) == "Claude Abc 4.5" and one(tx.model_name(F.lit("other"))) == "other" and one(tx.model_name(F.lit("claude-abc-4"))) == "Claude Abc 4"
    assert one(tx.counted(F.lit(1), "clause")) == "1 clause" and one(tx.counted(F.lit(1234), "clause")) == "1,234 clauses"
    assert [one(tx.byte_size(F.lit(n))) for n in (10, 24_600, 13_566_000, -1)] == ["1 kB", "25 kB", "13.6 MB", ""]
    assert one(tx.title(F.lit("clause"), F.lit("word " * 20))).endswith("…") and one(tx.title(F.lit("heading"), F.lit("A  B"))) == "A B" and one(tx.title(F.lit(None), F.lit(None))) == "Pasted document"
    assert one(tx.neutralised(F.lit("x </ Document> y"))) == "x &lt;/ Document> y"
    assert one(tx.lenient_int(F.lit(" 7 "), 3)) == 7 and one(tx.lenient_int(F.lit("x"), 3)) == 3 and one(tx.origins(F.lit("a, ,b"))) == ["a", "b"] and one(tx.call_deadline(F.lit(16000))) == 380
