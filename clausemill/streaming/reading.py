"""Documents read as they arrive: the batch plans on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import fingerprint, with_canonical
from ..operators.reading import finding_rows, reading_of


def document_stream(spark: SparkSession, folder: str, schema: str = "doc_id long, text string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def stream_findings(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Findings of a stream of documents; each document is read by itself, so no state is kept."""
    own = with_canonical(documents.select(id_col, "text"))
    return finding_rows(own.withColumn("sha256", fingerprint(F.col("text"))).withColumn("reading", reading_of(F.col("text"))), id_col)


def stream_tally(findings: DataFrame, watermark_col: str | None = None) -> DataFrame:
    """Running label counts (complete or update mode)."""
    labels = findings.where("rn = 1")
    return (labels.withWatermark(watermark_col, "1 hour") if watermark_col else labels).groupBy("favours").count()
