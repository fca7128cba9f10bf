"""The engine's own functions for SQL text."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import _canonical
from ..sources.html import texts_of_pages
from .segmentation import segments_of


def register(spark: SparkSession) -> None:
    """canonical_text(text), clause_segments(canonical text) and page_text(html), for this session's SQL."""
    spark.udf.register("canonical_text", _canonical)
    spark.udf.register("clause_segments", segments_of)
    spark.udf.register("page_text", F.arrow_udf(texts_of_pages, "string"))
