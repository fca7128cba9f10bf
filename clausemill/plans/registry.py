"""All queries over the driver's tables, by name, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.canonical import fingerprint, with_canonical
from ..operators import analytics, parts, quota, reports, routing, verification
from ..operators.layout import spread
from ..operators.reading import finding_rows, read_documents, plain_rules, rule_hits, rule_hits_sql, rule_table, top_findings
from ..operators.segmentation import line_rows, segment_rows
from ..sources import store
from ..sources.html import html_text
from .planted import TERMS_SQL, lines_sql, terms
from .segments_sql import segments_sql

FLAGSHIP = "clause_labels_exact"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- canonical text

NOISY = "SELECT doc_id, concat(chr(9), CASE WHEN doc_id % 3 = 0 THEN replace(text, ' ', chr(160) || ' ') WHEN doc_id % 3 = 1 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE replace(text, ' ', ' ' || chr(8203)) END, chr(12), 'End', chr(7), ' ') AS text FROM documents"


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    changed = (
        F.when(F.col("doc_id") % 3 == 0, F.replace(t, F.lit(" "), F.lit(chr(160) + " "))).when(F.col("doc_id") % 3 == 1, F.replace(t, F.lit("\n"), F.lit("\r\n"))).otherwise(F.replace(t, F.lit(" "), F.lit(" " + chr(8203))))
    )
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.concat(F.lit("\t"), changed, F.lit("\f"), F.lit("End"), F.lit("\x07"), F.lit(" ")).alias("text"))


def _canonical_sql(relation: str) -> str:
    t = "nfc_normalize(replace(replace(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(12), chr(10) || chr(10)), chr(8232), chr(10)), chr(8233), chr(10) || chr(10)))"
    controls = "'[' || chr(1) || '-' || chr(8) || chr(11) || chr(14) || '-' || chr(31) || chr(127) || ']'"
    invisible = "'[' || chr(8203) || chr(8204) || chr(8205) || chr(8288) || chr(65279) || chr(173) || ']'"
    spaces = "'[ ' || chr(9) || chr(160) || chr(5760) || chr(8192) || '-' || chr(8202) || chr(8239) || chr(8287) || chr(12288) || ']+'"
    for pattern, new in ((controls, "''"), (invisible, "''"), (spaces, "' '"), ("' *' || chr(10) || ' *'", "chr(10)"), ("'([^\\s.!?:;])' || chr(10) || '([a-z])'", "'\\1 \\2'"), ("chr(10) || '{3,}'", "chr(10) || chr(10)"), ("'^\\s+|\\s+$'", "''")):
        t = f"regexp_replace({t}, {pattern}, {new}, 'g')"
    return f"SELECT doc_id, {t} AS text FROM ({relation})"


@query(f"SELECT doc_id, length(text) AS n_chars, sha256(text) AS sha256 FROM ({_canonical_sql(NOISY)})")
def canonical_fingerprint(spark, sf_dir):
    own = with_canonical(noisy(spark, sf_dir))
    return own.select("doc_id", F.length("text").cast("long").alias("n_chars"), fingerprint(F.col("text")).alias("sha256"))


@query("SELECT doc_id, sha256(nfc_normalize(replace(text, chr(233), 'e' || chr(769)))) AS sha256, contains(text, chr(233)) AS had FROM documents")
def canonical_nfc(spark, sf_dir):
    from ..functions.canonical import _composed

    apart = F.replace(F.col("text"), F.lit(chr(233)), F.lit("e" + chr(769)))
    return table(spark, sf_dir, "documents").select("doc_id", fingerprint(_composed(apart)).alias("sha256"), F.col("text").contains(chr(233)).alias("had"))


@query(f"SELECT sha256, CAST(count(*) AS BIGINT) AS copies, min(doc_id) AS first_doc FROM (SELECT doc_id, sha256(text) AS sha256 FROM ({_canonical_sql('SELECT doc_id, text FROM documents')})) GROUP BY sha256")
def dedup_by_fingerprint(spark, sf_dir):
    own = with_canonical(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", fingerprint(F.col("text")).alias("sha256"))
    return own.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))


# ------------------------------------------------------------------ segmentation

_LINES = lines_sql(TERMS_SQL)
_SEGMENTS = segments_sql(_canonical_sql(TERMS_SQL))


@query(f'SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, start, "end", sha256(body) AS body_key FROM ({_LINES})')
def line_offsets(spark, sf_dir):
    return line_rows(terms(spark, sf_dir)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "start", "end", F.sha2("body", 256).alias("body_key"))


@query(f'SELECT doc_id, seg_no, kind, start, "end", clause_id FROM ({_SEGMENTS})')
def clause_segments(spark, sf_dir):
    """Exact segments of all documents."""
    return segment_rows(with_canonical(terms(spark, sf_dir).select("doc_id", "text"))).select("doc_id", "seg_no", "kind", "start", "end", "clause_id")


@query(f"SELECT lang, CAST(count(*) FILTER (kind = 'clause') AS BIGINT) AS clauses, CAST(count(*) FILTER (kind = 'heading') AS BIGINT) AS headings, CAST(max(length(body)) AS INTEGER) AS longest FROM ({_SEGMENTS}) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY lang")
def clause_stats_by_lang(spark, sf_dir):
    rows = segment_rows(with_canonical(terms(spark, sf_dir).select("doc_id", "text"))).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(F.count_if(F.col("kind") == "clause").alias("clauses"), F.count_if(F.col("kind") == "heading").alias("headings"), F.max(F.length("body")).alias("longest"))


# ------------------------------------------------------------------------- rules

_HITS = rule_hits_sql(_LINES)
_TOP = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY conf_rank DESC, weight DESC, rule_no) AS rn FROM ({_HITS})) WHERE rn <= 4"


def hits(spark, sf_dir):
    return rule_hits(line_rows(terms(spark, sf_dir)).select("doc_id", "line_no", "body"))


@query(f"SELECT topic, favours, CAST(count(*) AS BIGINT) AS clauses, CAST(count(DISTINCT doc_id) AS BIGINT) AS docs FROM ({_HITS}) GROUP BY topic, favours")
def rule_hits_by_topic(spark, sf_dir):
    return hits(spark, sf_dir).groupBy("topic", "favours").agg(F.count(F.lit(1)).alias("clauses"), F.countDistinct("doc_id").alias("docs"))


@query(f"SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(rn AS BIGINT) AS rn, rule_id, confidence FROM ({_TOP})")
def top_rule_findings(spark, sf_dir):
    return top_findings(hits(spark, sf_dir), ["doc_id", "line_no"]).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("rn").cast("long").alias("rn"), "rule_id", "confidence")


_LABELS = f"SELECT * FROM ({_TOP}) WHERE rn = 1"


@query("SELECT source, " + ", ".join(f"CAST(count(*) FILTER (favours = '{f}') AS BIGINT) AS n_{f}" for f in analytics.FAVOURS) + f" FROM ({_LABELS}) JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY source")
def tally_by_source(spark, sf_dir):
    labels = top_findings(hits(spark, sf_dir), ["doc_id", "line_no"], 1)
    return analytics.tally(labels.join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id"), ["source"])


_THEM = ", ".join(f"('{r.id}')" for r in plain_rules() if r.favours == "them")


@query(f"SELECT rule_id FROM (VALUES {_THEM}) AS r(rule_id) WHERE rule_id NOT IN (SELECT rule_id FROM ({_HITS}))")
def rules_never_found(spark, sf_dir):
    known = [r.id for r in plain_rules()]
    return analytics.never_found(rule_table(spark).where(F.col("rule_id").isin(known)), hits(spark, sf_dir)).select("rule_id")


@query(f"SELECT doc_id, CAST(count(*) AS BIGINT) AS unread FROM (SELECT doc_id, line_no FROM ({_LINES}) EXCEPT SELECT doc_id, line_no FROM ({_HITS})) GROUP BY doc_id")
def unlabelled_lines(spark, sf_dir):
    lines = line_rows(terms(spark, sf_dir)).select("doc_id", "line_no", "body")
    return analytics.unlabelled(lines.select("doc_id", "line_no"), rule_hits(lines), ["doc_id", "line_no"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("unread"))


_BY_RULE = f"SELECT doc_id, rule_id, CAST(count(*) AS INTEGER) AS n_clauses, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) FILTER (k <= 3) AS first_ids FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, rule_id ORDER BY line_no) AS k FROM ({_TOP})) GROUP BY doc_id, rule_id"


@query(_BY_RULE)
def checklist(spark, sf_dir):
    found = top_findings(hits(spark, sf_dir), ["doc_id", "line_no"]).withColumnRenamed("line_no", "clause_id")
    return analytics.checklist(found).select("doc_id", "rule_id", "n_clauses", "first_ids")


_GROUPS = " ".join(f"WHEN '{g}' THEN {i}" for i, g in enumerate(analytics.GROUPS, 1))


@query(f"""WITH t AS MATERIALIZED ({_TOP}), k AS (SELECT doc_id, rule_id, topic, favours, count(*) AS n, min(line_no) AS low, arg_min(rn, line_no) AS rn, string_agg(CAST(line_no AS VARCHAR), ', ' ORDER BY line_no) FILTER (i <= 3) AS ids
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, rule_id ORDER BY line_no) AS i FROM t) GROUP BY doc_id, rule_id, topic, favours),
p AS (SELECT *, topic || ' ¶ ' || ids || CASE WHEN n > 3 THEN ', …' ELSE '' END AS text FROM k)
SELECT doc_id, CAST(CASE favours {_GROUPS} END AS INTEGER) AS place, favours, CAST(count(*) AS BIGINT) AS n_kinds, string_agg(text, '; ' ORDER BY low, rn) AS found, CAST(CAST(sum(count(*)) OVER (PARTITION BY doc_id) AS BIGINT) AS VARCHAR) || ' of 53' AS of_all FROM p GROUP BY doc_id, favours""")
def checklist_groups(spark, sf_dir):
    found = top_findings(hits(spark, sf_dir), ["doc_id", "line_no"]).withColumnRenamed("line_no", "clause_id")
    return reports.checklist_groups(analytics.checklist(found), rule_table(spark))


@query()
def clause_labels_exact(spark, sf_dir):
    """Every finding of the exact reading, with verified quotes; rn 1 is the label."""
    return finding_rows(read_documents(terms(spark, sf_dir)))


@query()
def reading_counters(spark, sf_dir):
    r = read_documents(terms(spark, sf_dir))
    return r.select("doc_id", "sha256", "reading.received", "reading.verified", "reading.dropped", F.size("reading.segments").alias("segments"))


@query()
def response_payloads(spark, sf_dir):
    return store.payloads(read_documents(terms(spark, sf_dir)), "seg-2/rules-1")


_CALM = "regexp_replace(body, '(?i)<(\\s*/?\\s*document\\b)', '&lt;\\1', 'g')"


@query(f"""SELECT doc_id, '<document>' || chr(10) || string_agg(CASE WHEN kind = 'heading' THEN '§ ' || {_CALM} ELSE '[' || CAST(clause_id AS VARCHAR) || '] ' || {_CALM} END, chr(10) ORDER BY seg_no) || chr(10) || '</document>' || chr(10)
  || 'Annotate clauses ' || CAST(coalesce(min(clause_id), 1) AS VARCHAR) || ' to ' || CAST(coalesce(min(clause_id), 1) + count(clause_id) - 1 AS VARCHAR) || ': ' || CAST(count(clause_id) AS VARCHAR) || ' entries, one per clause.' AS prompt FROM ({_SEGMENTS}) GROUP BY doc_id""")
def reader_prompts(spark, sf_dir):
    rows = segment_rows(with_canonical(terms(spark, sf_dir).select("doc_id", "text")))
    return routing.prompts(rows)


# Rule, side, number of patterns and weight, written down apart from the library.
_RULE_ROWS = (
    "('arbitration', 'them', 6, 95), ('class_waiver', 'them', 5, 90), ('class_action_kept', 'you', 1, 70), ('jury_waiver', 'them', 2, 85), ('release', 'them', 2, 70), ('arbitration_opt_out', 'you', 2, 60), "
    "('time_limit', 'them', 3, 55), ('venue', 'them', 4, 45), ('local_courts', 'you', 1, 55), ('small_claims', 'you', 1, 40), ('informal_first', 'neutral', 1, 30), ('governing_law', 'neutral', 3, 30), "
    "('terms_changes', 'them', 2, 70), ('continued_use', 'them', 3, 65), ('changes_need_consent', 'you', 1, 65), ('advance_notice', 'you', 3, 35), ('termination', 'them', 3, 75), ('service_changes', "
    "'them', 4, 45), ('remove_content', 'them', 1, 40), ('assignment', 'them', 1, 25), ('you_cancel', 'you', 1, 50), ('mutual_termination', 'neutral', 1, 30), ('auto_renewal', 'them', 5, 60), "
    "('price_changes', 'them', 3, 50), ('no_refunds', 'them', 7, 60), ('extra_fees', 'them', 3, 45), ('expiring_credit', 'them', 1, 40), ('refund_right', 'you', 4, 55), ('liability_cap', 'them', 2, 70), "
    "('no_liability', 'them', 5, 65), ('no_warranty', 'them', 8, 50), ('warranty', 'you', 2, 50), ('accepts_liability', 'you', 1, 45), ('rights_kept', 'you', 4, 60), ('indemnity', 'them', 2, 80), "
    "('they_indemnify', 'you', 1, 75), ('account_risk', 'them', 1, 25), ('content_licence', 'them', 2, 80), ('licence_survives', 'them', 1, 70), ('you_own_content', 'you', 3, 65), ('app_licence', "
    "'neutral', 1, 20), ('data_sale', 'them', 2, 85), ('no_data_sale', 'you', 3, 80), ('data_sharing', 'them', 2, 75), ('data_processors', 'neutral', 2, 30), ('deidentified', 'unclear', 1, 35), "
    "('ai_training', 'them', 2, 70), ('no_ai_training', 'you', 1, 70), ('tracking', 'them', 5, 50), ('marketing_consent', 'them', 1, 40), ('opt_out', 'you', 2, 55), ('data_rights', 'you', 4, 55), "
    "('age_limit', 'neutral', 4, 20) "
)


@query(f"SELECT favours, CAST(count(*) AS BIGINT) AS rules, CAST(sum(n) AS BIGINT) AS patterns, CAST(max(weight) AS INTEGER) AS heaviest FROM (VALUES {_RULE_ROWS}) AS r(rule_id, favours, n, weight) GROUP BY favours")
def rule_catalogue(spark, sf_dir):
    return rule_table(spark).groupBy("favours").agg(F.count(F.lit(1)).alias("rules"), F.sum("n_patterns").alias("patterns"), F.max("weight").alias("heaviest"))


# ------------------------------------------------------------------ verification

_CLAUSES = f'SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS clause_id, start, "end", body FROM ({_LINES})'
_ITEMS = f"""
SELECT d.doc_id, CAST(1 AS INTEGER) AS item_no, CAST(1 + d.doc_id % 4 AS BIGINT) AS claimed_id, split_part(b.text, '.', 1) || '.' AS quote FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id
UNION ALL SELECT doc_id, CAST(3 * clause_id AS INTEGER), clause_id + doc_id % 2, substring(body, 1, 24) FROM ({_CLAUSES})
UNION ALL SELECT doc_id, CAST(3 * clause_id + 1 AS INTEGER), clause_id, substring(body, 3, 30) FROM ({_CLAUSES})
UNION ALL SELECT doc_id, CAST(3 * clause_id + 2 AS INTEGER), clause_id, body FROM ({_CLAUSES})"""
_PLACED = f"""
WITH c AS MATERIALIZED ({_CLAUSES}), i AS (SELECT doc_id, item_no, claimed_id, regexp_replace(quote, '^\\s+|\\s+$', '', 'g') AS quote FROM ({_ITEMS})),
t AS MATERIALIZED ({TERMS_SQL}),
a AS (SELECT i.*, t.text, c.start AS s, CASE WHEN c.start IS NOT NULL AND instr(c.body, i.quote) > 0 THEN c.start + instr(c.body, i.quote) - 1 END AS inside,
  CASE WHEN instr(t.text, i.quote) > 0 THEN instr(t.text, i.quote) - 1 END AS first
  FROM i JOIN t USING (doc_id) LEFT JOIN c ON c.doc_id = i.doc_id AND c.clause_id = i.claimed_id),
b AS (SELECT a.* EXCLUDE (text), first IS NOT NULL AND instr(substring(text, CAST(first + 2 AS BIGINT)), quote) > 0 AS again,
  length(quote) < 15 AND len(regexp_split_to_array(quote, '\\s+')) < 3 AND NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = a.doc_id AND c.body = a.quote) AS short FROM a),
o AS (SELECT b.*, c.clause_id AS oid, c."end" AS oe FROM b LEFT JOIN c ON c.doc_id = b.doc_id AND b.inside IS NULL AND NOT b.again AND c.start <= b.first AND b.first < c."end"),
r AS (SELECT *, CASE WHEN contains(quote, chr(10)) THEN 'crosses_clause' WHEN short THEN 'too_short' WHEN inside IS NOT NULL THEN NULL WHEN first IS NULL THEN 'not_found' WHEN again THEN 'ambiguous' WHEN oid IS NULL THEN 'not_found'
  WHEN first + length(quote) > oe THEN 'crosses_clause' END AS why FROM o),
p AS (SELECT *, CASE WHEN why IS NULL THEN CASE WHEN inside IS NOT NULL THEN claimed_id ELSE oid END END AS clause_id, CASE WHEN why IS NULL THEN COALESCE(inside, first) END AS quote_start, why IS NULL AND inside IS NULL AS moved FROM r)
SELECT doc_id, item_no, clause_id, quote_start, moved, CASE WHEN clause_id IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, clause_id ORDER BY item_no) > 1 THEN 'duplicate' ELSE why END AS reason FROM p"""


def placed(spark, sf_dir):
    own = terms(spark, sf_dir)
    lines = line_rows(own)
    from pyspark.sql.window import Window

    clauses = lines.withColumn("clause_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")).cast("long")).select("doc_id", "clause_id", "start", "end", "body")
    marks = table(spark, sf_dir, "benchmark")
    n = marks.count()
    first = F.concat(F.split_part("text", F.lit("."), F.lit(1)), F.lit("."))
    items = own.select("doc_id", (F.col("doc_id") % n).alias("item_id")).join(marks.select("item_id", first.alias("quote")), "item_id")
    items = items.select("doc_id", F.lit(1).alias("item_no"), (1 + F.col("doc_id") % 4).alias("claimed_id"), "quote")
    c = F.col("clause_id")
    items = items.union(clauses.select("doc_id", (3 * c).cast("int"), c + F.col("doc_id") % 2, F.substring("body", 1, 24)))
    items = items.union(clauses.select("doc_id", (3 * c + 1).cast("int"), c, F.substring("body", 3, 30)))
    items = items.union(clauses.select("doc_id", (3 * c + 2).cast("int"), c, "body"))
    return verification.placed_quotes(items.withColumn("malformed", F.lit(False)), own.select("doc_id", "text"), clauses)


@query(f"SELECT doc_id, item_no, clause_id, CAST(quote_start AS BIGINT) AS quote_start, moved, reason FROM ({_PLACED})")
def verify_quotes(spark, sf_dir):
    return placed(spark, sf_dir).select("doc_id", "item_no", "clause_id", F.col("quote_start").cast("long").alias("quote_start"), "moved", "reason")


@query(f"SELECT COALESCE(reason, 'verified') AS outcome, CAST(count(*) AS BIGINT) AS n FROM ({_PLACED}) GROUP BY 1")
def drop_reasons(spark, sf_dir):
    return placed(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("verified")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, CAST(count(*) AS BIGINT) AS received, CAST(count(*) FILTER (reason IS NULL) AS BIGINT) AS verified, CAST(count(*) FILTER (reason IS NOT NULL) AS BIGINT) AS dropped, CAST(count(*) FILTER (moved) AS BIGINT) AS relocated FROM ({_PLACED}) GROUP BY doc_id")
def verification_report(spark, sf_dir):
    return verification.verification_report(placed(spark, sf_dir))


# ------------------------------------------------------- parts, highlights, labels

_TURNS = "SELECT conv_id, turn, length(text) AS chars, CAST(1 + length(text) % 5 AS BIGINT) AS clauses, (conv_id + turn) % 7 = 0 AS failed FROM conversations"


@query(f"""SELECT conv_id, turn, CAST(COALESCE(SUM(CASE WHEN NOT failed THEN chars + 2 END) OVER w, 0) AS BIGINT) AS "offset", CAST(COALESCE(SUM(CASE WHEN NOT failed THEN clauses END) OVER w, 0) AS BIGINT) AS id_base
FROM ({_TURNS}) WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def stitch_conversations(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("part_no"), F.length("text").cast("long").alias("chars"), (1 + F.length("text") % 5).cast("long").alias("clauses"), ((F.col("conv_id") + F.col("turn")) % 7 == 0).alias("failed"))
    out = parts.stitched(turns.withColumn("segments", F.col("clauses")), "conv_id")
    return out.select("conv_id", F.col("part_no").alias("turn"), "offset", "id_base")


_SHOWN = "SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN NULL WHEN (conv_id + turn) % 3 = 0 THEN 'cache' ELSE 'model' END AS source, CASE WHEN turn % 2 = 0 THEN 'claude-sample-5' ELSE 'other' END AS model, length(text) AS chars FROM conversations"


@query(f"""WITH p AS ({_SHOWN}), r AS (SELECT * FROM p WHERE source IS NOT NULL),
m AS (SELECT conv_id, CASE model WHEN 'other' THEN 'other' ELSE 'Claude Sample 5' END AS alone, min(turn) AS first, CASE WHEN count(*) = 1 THEN 'part ' ELSE 'parts ' END || string_agg(CAST(turn AS VARCHAR), ', ' ORDER BY turn) AS nos FROM r GROUP BY conv_id, model),
t AS (SELECT conv_id, count(*) AS n, bool_and(source = 'cache') AS all_cached, coalesce(bool_or(source = 'cache'), false) AS some_cached, coalesce(bool_or(source IS NOT NULL AND model = 'other'), false) AS other FROM p GROUP BY conv_id),
w AS (SELECT conv_id, string_agg(CASE WHEN n > 1 THEN alone || ' (' || nos || ')' ELSE alone END, ' and ' ORDER BY first) AS who FROM m JOIN t USING (conv_id) GROUP BY conv_id)
SELECT conv_id, CASE WHEN who IS NULL THEN 'Not read.' ELSE CASE WHEN all_cached THEN 'From the cache, read before by ' || who ELSE 'Read by ' || who || CASE WHEN some_cached THEN ', in part from the cache' ELSE '' END END || '.' || CASE WHEN other THEN ' Another model answered where the first declined.' ELSE '' END END AS provenance
FROM t LEFT JOIN w USING (conv_id)""")
def reading_sources(spark, sf_dir):
    c, t = F.col("conv_id"), F.col("turn")
    source = F.when(t % 4 == 3, None).when((c + t) % 3 == 0, "cache").otherwise("model")
    shown = table(spark, sf_dir, "conversations").select(c, t.alias("part_no"), source.alias("source"), F.when(t % 2 == 0, "claude-sample-5").otherwise("other").alias("model"))
    return reports.provenance(shown, "claude-sample-5", "conv_id")


@query(f"""SELECT conv_id, CAST(count(*) AS BIGINT) AS n_parts, CAST(sum(chars) AS BIGINT) AS chars, CAST(least(40 - conv_id % 41, 8 - conv_id % 9) AS BIGINT) AS "left", count(*) <= least(40 - conv_id % 41, 8 - conv_id % 9) AS enough FROM ({_SHOWN}) GROUP BY conv_id""")
def reading_plans(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("part_no"), F.length("text").cast("long").alias("chars"))
    c = F.col("conv_id")
    left = turns.select("conv_id").distinct().withColumn("left", reports.readings_left(40 - c % 41, 8 - c % 9).cast("long"))
    return reports.reading_plan(turns, left, "conv_id").select("conv_id", "n_parts", "chars", "left", "enough")


@query()
def document_parts(spark, sf_dir):
    """All documents in parts of at most 10,000 units."""
    return parts.part_rows(table(spark, sf_dir, "documents")).select("doc_id", "part_no", F.length("text").alias("chars"))


_MARKS = """SELECT doc_id, CAST(m AS INTEGER) AS mark, (doc_id * (m + 3)) % (n_chars + 7) - 3 AS start, (doc_id * (m + 3)) % (n_chars + 7) - 3 + 5 + (doc_id * (m + 1)) % 200 AS "end", n_chars FROM (SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars FROM documents), (VALUES (0), (1), (2), (3)) AS k(m)"""


@query(f"""WITH k AS (SELECT doc_id, mark, n_chars, greatest(start, 0) AS s, least("end", n_chars) AS e FROM ({_MARKS})), i AS (SELECT * FROM k WHERE s < e),
cuts AS (SELECT doc_id, s AS cut_at FROM i UNION SELECT doc_id, e FROM i UNION SELECT doc_id, 0 FROM documents UNION SELECT doc_id, length(text) FROM documents),
st AS (SELECT doc_id, cut_at, lead(cut_at) OVER (PARTITION BY doc_id ORDER BY cut_at) AS nxt FROM cuts),
m AS (SELECT st.doc_id, st.cut_at, st.nxt, COALESCE(min(i.mark), -1) AS mark FROM st LEFT JOIN i ON i.doc_id = st.doc_id AND i.s <= st.cut_at AND st.nxt <= i.e WHERE st.nxt IS NOT NULL GROUP BY 1, 2, 3),
f AS (SELECT *, CASE WHEN lag(mark) OVER (PARTITION BY doc_id ORDER BY cut_at) = mark THEN 0 ELSE 1 END AS new FROM m),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY cut_at) AS run FROM f)
SELECT doc_id, CAST(min(cut_at) AS BIGINT) AS start, CAST(max(nxt) AS BIGINT) AS "end", mark FROM g GROUP BY doc_id, run, mark""")
def highlight_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n"))
    m, i, n = F.col("mark"), F.col("doc_id"), F.col("n")
    marks = docs.withColumn("mark", F.explode(F.array(*[F.lit(x) for x in range(4)])))
    start = (i * (m + 3)) % (n + 7) - 3
    marks = marks.select("doc_id", "mark", start.alias("start"), (start + 5 + (i * (m + 1)) % 200).alias("end"))
    return analytics.highlight_runs(docs.select("doc_id", F.lit(0).cast("long").alias("start"), n.alias("end")), marks, ["doc_id"])


@query("""SELECT COALESCE(hand, 'all') AS hand, CAST(count(*) FILTER (found = 'long') AS BIGINT) AS n_long, CAST(count(*) FILTER (found = 'short') AS BIGINT) AS n_short, CAST(count(*) FILTER (found = 'none') AS BIGINT) AS n_none, CAST(count(*) AS BIGINT) AS total
FROM (SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS hand, COALESCE(CASE WHEN n_chars % 3 = 0 THEN NULL WHEN n_chars > 1500 THEN 'long' ELSE 'short' END, 'none') AS found FROM labels LEFT JOIN documents USING (doc_id)) GROUP BY ROLLUP (hand)""")
def label_agreement(spark, sf_dir):
    hand = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("hand"))
    n = F.col("n_chars")
    found = table(spark, sf_dir, "documents").where(n % 3 != 0).select("doc_id", F.when(n > 1500, "long").otherwise("short").alias("found"))
    return analytics.agreement(hand, found, ["doc_id"], ["good", "bad"], ["long", "short"])


# ------------------------------------------------------------ quota, cache, requests

_REQUESTS = "SELECT event_id AS request_id, ts, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN user_id % 5 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS visitor FROM events"
_DECIDED = f"""WITH a AS (SELECT *, visitor IS NULL OR row_number() OVER (PARTITION BY day, visitor ORDER BY ts, request_id) <= 3 AS able FROM ({_REQUESTS})),
b AS (SELECT *, COALESCE(sum(CAST(able AS BIGINT)) OVER (PARTITION BY day ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM a),
c AS (SELECT *, CASE WHEN n >= 40 THEN 'daily' WHEN NOT able THEN 'visitor' END AS reason FROM b)
SELECT request_id, day, visitor, reason, least(n, 40) + CASE WHEN reason IS NULL THEN 1 ELSE 0 END AS used, CASE WHEN visitor IS NULL THEN 0 ELSE sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY day, visitor ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING) END AS taken FROM c"""


def requests(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("request_id"), "ts", tx.utc_day(F.col("ts")).alias("day"), F.when(F.col("user_id") % 5 != 0, F.col("user_id").cast("string")).alias("visitor"))


@query(f"SELECT request_id, reason IS NULL AS allowed, reason, CAST(used AS BIGINT) AS used, CAST(greatest(0, 40 - used) AS BIGINT) AS remaining, CAST(greatest(0, 3 - taken) AS BIGINT) AS visitor_remaining FROM ({_DECIDED})")
def quota_decisions(spark, sf_dir):
    return quota.decisions(requests(spark, sf_dir), 40, 3).select("request_id", "allowed", "reason", "used", "remaining", "visitor_remaining")


@query(f"SELECT day, CAST(count(*) AS BIGINT) AS requests, CAST(count(*) FILTER (reason IS NULL) AS BIGINT) AS used, CAST(greatest(0, 40 - count(*) FILTER (reason IS NULL)) AS BIGINT) AS remaining, CAST(count(*) FILTER (reason = 'visitor') AS BIGINT) AS visitor_denied, CAST(count(*) FILTER (reason = 'daily') AS BIGINT) AS daily_denied FROM ({_DECIDED}) GROUP BY day")
def quota_by_day(spark, sf_dir):
    return quota.day_status(quota.decisions(requests(spark, sf_dir), 40, 3), 40)


def _pad_sql(byte: int) -> str:
    return f"unhex(array_to_string(list_transform(range(1, 65), lambda i: printf('%02x', xor(CASE WHEN i <= 32 THEN ascii(substr(salt, CAST(i AS BIGINT), 1)) ELSE 0 END, {byte}))), ''))"


@query(f"""SELECT day, visitor, CASE WHEN visitor <> '' THEN substr(sha256({_pad_sql(0x5C)} || unhex(sha256({_pad_sql(0x36)} || encode(visitor)))), 1, 32) END AS name
FROM (SELECT DISTINCT day, visitor, substr(sha256(day), 1, 32) AS salt FROM ({_REQUESTS}))""")
def visitor_names(spark, sf_dir):
    """Pseudonyms of visitors by day (HMAC-SHA256). So that reruns agree the salts follow from the days here; quota.new_salts draws them."""
    r = requests(spark, sf_dir).select("day", "visitor").distinct()
    return r.withColumn("name", quota.visitor_name(F.substring(F.sha2("day", 256), 1, 32), F.col("visitor")))


_CACHE = "SELECT sha256(text) AS text_sha256, 'seg-2/p-' || CAST(doc_id % 3 AS VARCHAR) AS pipeline, CASE WHEN doc_id % 11 = 0 THEN 'broken' ELSE '{\"verified\": ' || CAST(doc_id AS VARCHAR) || '}' END AS analysis, CAST(1000000 + doc_id % 13 AS VARCHAR) AS created_at FROM documents"


def cache(spark, sf_dir):
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.sha2("text", 256).alias("text_sha256"), F.concat(F.lit("seg-2/p-"), (i % 3).cast("string")).alias("pipeline"),
        F.when(i % 11 == 0, "broken").otherwise(F.concat(F.lit('{"verified": '), i.cast("string"), F.lit("}"))).alias("analysis"), (1000000 + i % 13).cast("string").alias("created_at")
    )


_LATEST = f"SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY text_sha256, pipeline ORDER BY created_at DESC, analysis DESC) AS n FROM ({_CACHE})) WHERE n = 1"


@query(_LATEST)
def cache_latest(spark, sf_dir):
    return store.latest(cache(spark, sf_dir))


@query(f"SELECT doc_id, r.text_sha256, r.pipeline FROM (SELECT doc_id, sha256(text) AS text_sha256, CASE WHEN doc_id % 5 = 0 THEN 'seg-2/p-new' ELSE 'seg-2/p-' || CAST(doc_id % 3 AS VARCHAR) END AS pipeline FROM documents) r WHERE NOT EXISTS (SELECT 1 FROM ({_LATEST}) c WHERE c.text_sha256 = r.text_sha256 AND c.pipeline = r.pipeline AND c.analysis <> 'broken')")
def cache_misses(spark, sf_dir):
    i = F.col("doc_id")
    pipeline = F.when(i % 5 == 0, "seg-2/p-new").otherwise(F.concat(F.lit("seg-2/p-"), (i % 3).cast("string")))
    asked = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha256"), pipeline.alias("pipeline"))
    return store.misses(asked, cache(spark, sf_dir)).select("doc_id", "text_sha256", "pipeline")


@query("""WITH d AS (SELECT user_id, event_id, ts, event_type AS key, CAST(200000 + event_id % 500000 AS BIGINT) AS size FROM events),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, key ORDER BY ts DESC, event_id DESC) AS n FROM d) WHERE n = 1),
p AS (SELECT *, row_number() OVER w AS place, sum(size) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS total FROM o WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC))
SELECT user_id, key, event_id, CAST(place AS BIGINT) AS place FROM p WHERE place <= 5 AND (total <= 1500000 OR place = 1)""")
def recent_documents(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("request_id"), "ts", F.col("event_type").alias("key"), (200000 + F.col("event_id") % 500000).alias("size"))
    return store.history(e, "user_id").select("user_id", "key", F.col("request_id").alias("event_id"), F.col("place").cast("long").alias("place"))


_KINDS = [o[0] for o in routing.OUTCOMES]
_OUTCOME_VALUES = ", ".join(f"('{f}', '{n}', '{e}', {str(r).lower()})" for f, n, e, r in routing.OUTCOMES)


@query(f"""WITH c AS (SELECT event_id, list_extract([{', '.join(f"'{k}'" for k in _KINDS)}, 'none'], CAST(event_id % 9 + 1 AS BIGINT)) AS failure, CAST(event_id % 41 AS BIGINT) AS used FROM events)
SELECT event_id, notice, error, CASE WHEN COALESCE(refunded, false) THEN greatest(0, used - 1) ELSE used END AS used, CASE WHEN COALESCE(refunded, false) THEN least(40, 40 - used + 1) ELSE 40 - used END AS remaining
FROM c LEFT JOIN (VALUES {_OUTCOME_VALUES}) AS o(failure, notice, error, refunded) USING (failure)""")
def request_outcomes(spark, sf_dir):
    i = F.col("event_id")
    kinds = F.array(*[F.lit(k) for k in [*_KINDS, "none"]])
    calls = table(spark, sf_dir, "events").select("event_id", F.element_at(kinds, (i % 9 + 1).cast("int")).alias("failure"), (i % 41).alias("used"))
    calls = calls.withColumns({"limit": F.lit(40).cast("long"), "remaining": 40 - F.col("used"), "visitor_remaining": F.lit(8).cast("long")})
    return routing.with_outcome(calls).select("event_id", "notice", "error", "used", "remaining")


@query("""SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'no_clauses' WHEN doc_id % 13 = 0 THEN 'cache' WHEN doc_id % 11 = 0 THEN 'demo_mode' WHEN length(text) > 10000 THEN 'too_long' WHEN len(string_split(text, '.')) > 120 THEN 'too_many_clauses'
WHEN doc_id % 7 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'visitor_limit' ELSE 'budget_spent' END ELSE 'model' END AS decision FROM documents""")
def request_decisions(spark, sf_dir):
    i = F.col("doc_id")
    clauses = F.when(i % 17 == 0, 0).otherwise(F.size(F.split("text", r"\.")))
    decision = routing.route(clauses, i % 13 == 0, i % 11 != 0, F.length("text"), i % 7 != 0, F.when(i % 2 == 0, "visitor").otherwise("daily"))
    return table(spark, sf_dir, "documents").select("doc_id", decision.alias("decision"))


# ----------------------------------------------------------------- pages and functions


@query()
def pages_to_text(spark, sf_dir):
    """Text of all pages; tests hold it against expectations."""
    return table(spark, sf_dir, "pages").select("page_id", html_text(F.col("html")).alias("text"))


_TAG = "</?(?:p|div|li|ul|ol|h[1-6]|br|section|article|span|a|strong|em|b|i|table|tr|td|body|html|head|main)\\b[^>]*>"


@query(f"SELECT page_id, len(regexp_extract_all(left(html, CAST(length(html) - instr(reverse(html), '>') + 1 AS BIGINT)), '{_TAG}', 0, 'i')) >= 2 AS html FROM pages UNION ALL SELECT doc_id + 1000000000, len(regexp_extract_all(text, '{_TAG}', 0, 'i')) >= 2 FROM documents")
def html_sniff(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", tx.looks_like_html(F.col("html")).alias("html"))
    return pages.union(table(spark, sf_dir, "documents").select(F.col("doc_id") + 1000000000, tx.looks_like_html(F.col("text"))))


@query("""SELECT doc_id, CASE WHEN n < 1000000 THEN CAST(greatest(1, CAST(floor(n / 1000.0 + 0.5) AS BIGINT)) AS VARCHAR) || ' kB' ELSE printf('%.1f', n / 1000000.0) || ' MB' END AS size,
CASE WHEN length(head) > 60 THEN regexp_replace(substring(head, 1, 57), '\\s+\\S*$', '') || '…' ELSE head END AS title, replace(text, 'x', '') = text AS plain
FROM (SELECT doc_id, text, n_chars * 997 AS n, regexp_replace(regexp_replace(split_part(text, chr(10), 1), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS head FROM documents)""")
def document_titles(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    head = F.split_part("text", F.lit("\n"), F.lit(1))
    return d.select("doc_id", tx.byte_size(F.col("n_chars") * 997).alias("size"), tx.title(F.lit("clause"), head).alias("title"), (~F.col("text").contains("x")).alias("plain"))


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS code_points, CAST(strlen(text) AS BIGINT) AS bytes FROM documents")
def text_sizes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.code_points(F.col("text")).cast("long").alias("code_points"), F.octet_length("text").cast("long").alias("bytes"))
