"""Terms for the rules to find: the driver's texts hold no legal words, so clauses are planted in them.

Which clauses a document gets follows from its id, by an expression that Spark
and SQL share. The documents themselves are all there, whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.layout import spread

CLAUSES = (
    "You agree to binding arbitration, and no court will hear your case.",
    "Any dispute shall be resolved by arbitration in the city we name.",
    "We may change these terms at any time by posting them here.",
    "Your plan renews automatically until you cancel it in writing.",
    "You may cancel at any time, free of charge.",
    "We do not sell your personal information to anyone.",
    "We may share your personal information with advertisers and partners.",
    "All fees are non-refundable once the month has begun.",
    "Our total liability will not exceed the amount you paid last year.",
    "The service is provided as is, without warranty of any kind.",
    "You keep ownership of your photos and files.",
    "These terms are governed by the laws of Northland.",
    "You must be at least 16 years old to sign up.",
    "We will notify you at least 30 days before prices rise.",
    "We may suspend your account at any time for any reason.",
    "You agree to indemnify us against claims of others.",
    "Nothing in these terms limits your rights as a consumer.",
    "Late fees apply; interest at 5% runs from the due date.",
    "We use cookies and pixels to learn what you like.",
    "Weather in the valley is mild, and trains run hourly.",
)
HEADING = "Rights And Duties"


def _pick(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in CLAUSES]), (F.pmod(n, F.lit(len(CLAUSES))) + 1).cast("int"))


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with three planted clauses below a heading: doc_id, source, lang, text."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text"))
    i = F.col("doc_id")
    text = F.concat_ws("\n", F.col("text"), F.lit(HEADING), _pick(i), _pick(i * 7 + 3), _pick(i * 11 + 5))
    return docs.select("doc_id", "source", "lang", text.alias("text"))


_LIST = "[" + ", ".join("'" + c.replace("'", "''") + "'" for c in CLAUSES) + "]"


def _pick_sql(n: str) -> str:
    return f"list_extract({_LIST}, CAST((({n}) % {len(CLAUSES)}) + 1 AS BIGINT))"


TERMS_SQL = f"SELECT doc_id, source, lang, concat_ws(chr(10), text, '{HEADING}', {_pick_sql('doc_id')}, {_pick_sql('doc_id * 7 + 3')}, {_pick_sql('doc_id * 11 + 5')}) AS text FROM documents"


def lines_sql(relation: str) -> str:
    """doc_id, line_no, start, end and body of every line that isn't blank."""
    split = f"SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM ({relation})"
    at = f"SELECT doc_id, line_no, line, COALESCE(SUM(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_at FROM ({split})"
    trimmed = f"SELECT doc_id, line_no, CAST(line_at + length(line) - length(regexp_replace(line, '^\\s+', '')) AS BIGINT) AS start, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS body FROM ({at})"
    return f'SELECT doc_id, line_no, start, start + length(body) AS "end", body FROM ({trimmed}) WHERE length(body) > 0'
