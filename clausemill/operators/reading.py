"""Readings of documents by the rule library: exact in Python, or boolean in the JVM."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.canonical import fingerprint, with_canonical
from ..functions.clauses import segments
from ..functions.findings import KEPT, RANK, company_names, expand, needed_literals, read, rules
from ..functions.rule_values import RULES

FINDING = "rule string, topic string, favours string, confidence string, reading string, quote_start int, quote_end int"
READING = (
    f"struct<segments array<struct<kind string, start int, end int, clause_id int>>, readings array<struct<id int, findings array<struct<{FINDING}>>>>,"
    " received int, verified int, dropped int, relocated int, dropped_reasons map<string, int>>"
)
_FINDING = pa.struct([("rule", pa.string()), ("topic", pa.string()), ("favours", pa.string()), ("confidence", pa.string()), ("reading", pa.string()), ("quote_start", pa.int32()), ("quote_end", pa.int32())])
_READING = pa.struct(
    [
        ("segments", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("clause_id", pa.int32())]))),
        ("readings", pa.list_(pa.struct([("id", pa.int32()), ("findings", pa.list_(_FINDING))]))),
        ("received", pa.int32()), ("verified", pa.int32()), ("dropped", pa.int32()), ("relocated", pa.int32()), ("dropped_reasons", pa.map_(pa.string(), pa.int32())),
    ]
)


def _read_all(texts: pa.Array, library: tuple = RULES) -> pa.Array:
    out = []
    for x in texts.to_pylist():
        if x is None:
            out.append(None)
            continue
        parts = segments(x)
        found = read(x, parts, library)
        found["dropped_reasons"] = list(found["dropped_reasons"].items())
        out.append(found | {"segments": [{"kind": s.kind, "start": s.start, "end": s.end, "clause_id": s.id} for s in parts]})
    return pa.array(out, _READING)


def reading_of(text: Column, library: tuple = RULES) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        return _read_all(texts, library)

    return F.arrow_udf(run, READING)(text)


def library_of(rows: DataFrame) -> tuple:
    """Rules written as a table (rule_no, rule_id, topic, favours, confidence, weight, negatable, not_you, strong, unless, patterns: array of struct<pattern, confidence>), in the form that read_documents takes. A library is some hundred rows."""
    out = []
    for r in rows.orderBy("rule_no").collect():
        flags = " ".join(f for f in ("negatable", "not_you") if r[f])
        out.append((r.rule_id, r.topic, r.favours, r.confidence, r.weight, flags, r.strong, r.unless, tuple((p.pattern, p.confidence or r.confidence) for p in r.patterns)))
    return tuple(out)


def read_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", library: tuple = RULES) -> DataFrame:
    """id, text (canonical), sha256 and reading of every document. Equal texts are read once, and found by their fingerprint. library: other rules than the engine's own, or more."""
    own = with_canonical(docs.select(id_col, F.col(text_col).alias("text")))
    own = own.withColumn("sha256", fingerprint(F.col("text")))
    # A stated number of partitions isn't coalesced by size: reading costs far more than the bytes suggest.
    session = docs.sparkSession
    n = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    once = own.select("sha256", "text").repartition(n, "sha256").dropDuplicates(["sha256"]).select("sha256", reading_of(F.col("text"), library).alias("reading"))
    return own.join(once, "sha256", "left").select(id_col, "text", "sha256", "reading")


def finding_rows(read_docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, clause_id, rn, rule, topic, favours, confidence, quote_start, quote_end and quote of every finding; rn 1 is the clause's label."""
    # Outer forms: an inferred filter on the arrays would run the reading twice.
    clauses = read_docs.select(id_col, "text", F.inline_outer("reading.readings").alias("clause_id", "findings"))
    rows = clauses.select(id_col, "text", "clause_id", F.posexplode_outer("findings").alias("pos", "f")).where("pos is not null")
    quote = F.substring("text", F.col("f.quote_start") + 1, F.col("f.quote_end") - F.col("f.quote_start"))
    return rows.select(id_col, "clause_id", (F.col("pos") + 1).alias("rn"), "f.rule", "f.topic", "f.favours", "f.confidence", "f.quote_start", "f.quote_end", quote.alias("quote"))


def rule_table(spark: SparkSession) -> DataFrame:
    """The catalogue: one row for each rule."""
    rows = [(r.no, r.id, r.topic, r.favours, r.reading, r.confidence, r.weight, r.strong, r.unless, r.negatable, r.not_you, len(r.patterns)) for r in rules()]
    return spark.createDataFrame(rows, "rule_no int, rule_id string, topic string, favours string, reading string, confidence string, weight int, strong string, unless string, negatable boolean, not_you boolean, n_patterns int")


def looks_around(pattern: str | None) -> bool:
    return bool(pattern and re.search(r"\(\?<?[!=]", pattern))


def plain_rules() -> list:
    """Rules without look-around outside the tail: these mean the same to every engine on ASCII text."""
    return [r for r in rules() if not looks_around(r.unless) and not any(looks_around(p) for p, _ in r.patterns)]


def _any_of(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def _matched(body: Column, low: Column, pattern: str, options: str = "i") -> Column:
    """Whether the pattern matches; only run on bodies with one of the literals that every match needs."""
    found = body.rlike(f"(?{options})" + pattern)
    literals = sorted(needed_literals(pattern))
    if not literals:
        return found
    some = low.contains(literals[0])
    for x in literals[1:]:
        some = some | low.contains(x)
    return some & found


def rule_hits(bodies: DataFrame, body_col: str = "body") -> DataFrame:
    """A row for each clause and plain rule with a match, its confidence and rank; boolean, all in the JVM.

    Every rule is one literal pattern on the body, so nothing is joined: a
    clause's hits are an array that is then unfolded. Quotes, negation and
    subject are the exact reading's business.
    """
    hits, body, low = [], F.col(body_col), F.col("_low")
    for r in plain_rules():
        by_level: dict[str, list[str]] = {}
        for p, level in r.patterns:
            by_level.setdefault(level, []).append(expand(p, tail=False))
        level = F.lit(None).cast("string")
        for name in sorted(by_level, key=RANK.get):
            level = F.when(_matched(body, low, _any_of(by_level[name])), F.lit(name)).otherwise(level)
        if r.strong:
            level = F.when((level == "medium") & _matched(body, low, expand(r.strong)), F.lit("high")).otherwise(level)
        if r.unless:
            level = F.when(~_matched(body, low, expand(r.unless), "is"), level)
        hits.append(F.struct(F.lit(r.no).alias("rule_no"), F.lit(r.id).alias("rule_id"), F.lit(r.topic).alias("topic"), F.lit(r.favours).alias("favours"), F.lit(r.weight).alias("weight"), level.alias("confidence")))
    rows = bodies.withColumn("_low", F.lower(body)).withColumn("_hit", F.explode(F.filter(F.array(*hits), lambda h: h["confidence"].isNotNull())))
    rank = F.create_map(*[F.lit(x) for pair in RANK.items() for x in pair])
    return rows.select(*[c for c in bodies.columns if c != body_col], "_hit.*").withColumn("conf_rank", rank[F.col("confidence")])


def rule_hits_sql(lines: str) -> str:
    """SQL for rule_hits() over a relation of columns doc_id, line_no and body."""
    parts = []
    for r in plain_rules():
        by_level: dict[str, list[str]] = {}
        for p, level in r.patterns:
            by_level.setdefault(level, []).append(expand(p, tail=False))

        def match(pattern: str, options: str = "i") -> str:
            return f"regexp_matches(body, '{pattern.replace(chr(39), chr(39) * 2)}', '{options}')"

        level = "CASE " + " ".join(f"WHEN {match(_any_of(by_level[n]))} THEN '{n}'" for n in sorted(by_level, key=RANK.get, reverse=True)) + " END"
        if r.strong:
            level = f"CASE WHEN ({level}) = 'medium' AND {match(expand(r.strong))} THEN 'high' ELSE ({level}) END"
        if r.unless:
            level = f"CASE WHEN NOT {match(expand(r.unless), 'is')} THEN {level} END"
        topic = r.topic.replace("'", "''")
        parts.append(f"SELECT doc_id, line_no, {r.no} AS rule_no, '{r.id}' AS rule_id, '{topic}' AS topic, '{r.favours}' AS favours, {r.weight} AS weight, {level} AS confidence FROM ({lines})")
    return "SELECT *, CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS conf_rank FROM (" + " UNION ALL ".join(parts) + ") WHERE confidence IS NOT NULL"


def top_findings(hits: DataFrame, keys: list[str], k: int = KEPT) -> DataFrame:
    """The best k of each clause: confidence, weight, then order of the rules; rn 1 is its label."""
    best = Window.partitionBy(*keys).orderBy(F.desc("conf_rank"), F.desc("weight"), "rule_no")
    return hits.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k)


def names_of(text: Column) -> Column:
    """What a document calls the company."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else list(company_names(x)) for x in texts.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(text)


