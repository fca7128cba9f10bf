"""Segments of documents as rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.clauses import segments

SEGMENTS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("clause_id", T.IntegerType()), T.StructField("body", T.StringType())]))


@F.arrow_udf(SEGMENTS)
def segments_of(texts: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("clause_id", pa.int32()), ("body", pa.string())]))
    return pa.array([None if x is None else [{"kind": s.kind, "start": s.start, "end": s.end, "clause_id": s.id, "body": x[s.start : s.end]} for s in segments(x)] for x in texts.to_pylist()], kind)


def segment_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, seg_no, kind, start, end, clause_id and body of every segment of canonical texts."""
    # Bodies come with the segments: the text itself isn't carried through the unfolding. The outer form keeps the
    # optimizer from testing the array in a filter of its own, for which it would compute everything twice.
    rows = docs.select(id_col, segments_of(F.col(text_col)).alias("_s")).select(id_col, F.posexplode_outer("_s").alias("seg_no", "s")).where("seg_no is not null")
    return rows.select(id_col, "seg_no", "s.kind", "s.start", "s.end", "s.clause_id", "s.body")


def clause_rows(segments_df: DataFrame) -> DataFrame:
    return segments_df.where(F.col("kind") == "clause")


def line_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, line_no, start, end, body of every line that isn't blank, by built-in functions alone.

    Offsets are running sums over a document's lines.
    """
    lines = F.split(F.col(text_col), "\n")
    exploded = docs.select(F.col(id_col), F.posexplode(lines).alias("pos", "line"))
    before = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0))
    lead = F.length("line") - F.length(F.regexp_replace("line", r"^\s+", ""))
    body = F.regexp_replace("line", r"^\s+|\s+$", "")
    rows = exploded.select(id_col, (F.col("pos") + 1).alias("line_no"), (at + lead).cast("long").alias("start"), body.alias("body"))
    return rows.where(F.length("body") > 0).withColumn("end", F.col("start") + F.length("body")).select(id_col, "line_no", "start", "end", "body")
