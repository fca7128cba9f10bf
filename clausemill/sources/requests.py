"""Requests as a table: bodies checked and parsed, every refusal with its status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Sizes that are let in.
BODY_BYTES, DOCUMENT_CHARS, PART_CHARS, PART_CLAUSES = 512_000, 60_000, 10_000, 120


def bodies_of(chunks: DataFrame, cap: int = BODY_BYTES) -> DataFrame:
    """request_id, body (null if above the cap) of chunk rows (request_id, chunk_no, data). Sizes are summed before any chunk is read on."""
    so_far = F.sum(F.octet_length("data")).over(Window.partitionBy("request_id").orderBy("chunk_no"))
    total = F.max("_n")
    rows = chunks.withColumn("_n", so_far)
    kept = F.array_sort(F.collect_list(F.when(F.col("_n") <= cap, F.struct("chunk_no", F.hex("data").alias("h")))))
    joined = F.unhex(F.array_join(F.transform(kept, lambda x: x["h"]), ""))
    return rows.groupBy("request_id").agg(F.when(total <= cap, joined).alias("body"))


def parsed_requests(requests: DataFrame) -> DataFrame:
    """requests (request_id, method, path, content_type, body) with text, status and error; status 200 where all is well.

    If there is a column content_length, a request that states too large a one
    is refused before its body is looked at.
    """
    body = F.when(F.col("content_length").isNull() | (F.col("content_length") <= BODY_BYTES), F.col("body")) if "content_length" in requests.columns else F.col("body")
    text = F.try_validate_utf8(body.cast("string"))
    json = F.try_parse_json(text)
    value = F.try_variant_get(json, "$.text", "variant")
    is_text = F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))
    api = F.col("path") == "/api/analyze"
    stated = F.coalesce(F.col("content_length") > BODY_BYTES, F.lit(False)) if "content_length" in requests.columns else F.lit(False)
    status, error = F.lit(200), F.lit(None).cast("string")
    for bad, code, name in reversed(
        [
            (~F.col("path").isin("/api/analyze", "/api/status"), 404, "not_found"),
            (F.col("method") == "OPTIONS", 204, None),
            (api & (F.col("method") != "POST") | ~api & (F.col("method") != "GET"), 405, "method_not_allowed"),
            (api & ~F.coalesce(F.lower("content_type"), F.lit("")).startswith("application/json"), 415, "unsupported_media_type"),
            (api & stated, 413, "too_large"),
            (api & (F.col("body").isNull() | (F.octet_length("body") > BODY_BYTES)), 413, "too_large"),
            (api & json.isNull(), 400, "bad_json"),
            (api & ~is_text, 400, "bad_request"),
        ]
    ):
        status, error = F.when(bad, code).otherwise(status), F.when(bad, name).otherwise(error)
    good = F.when((status == 200) & api, F.try_variant_get(json, "$.text", "string"))
    return requests.withColumns({"status": status, "error": error, "text": good})


def size_error(raw: Column, text: Column) -> Column:
    """Why a document isn't read: too_large before or after canonicalisation, or empty; null if it is."""
    return F.when(F.length(raw) > 2 * DOCUMENT_CHARS, "too_large").when(text == "", "empty").when(F.length(text) > DOCUMENT_CHARS, "too_large")
