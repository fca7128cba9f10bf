"""What becomes of a request: one ordered decision, the reader's boundary, and the meaning of its failures."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import neutralised

# Limits of one call; failure, notice, logged error and whether the unit of quota is given back.
CALL_CHARS, CALL_CLAUSES = 10_000, 120
OUTCOMES = (
    ("unavailable:config", "model_error", "config", True),
    ("unavailable:network", "model_error", "network", True),
    ("unavailable:upstream", "model_error", "upstream", True),
    ("unavailable:busy", "model_busy", "busy", True),
    ("incomplete:timeout", "model_timeout", "timeout", False),
    ("incomplete:interrupted", "model_interrupted", "interrupted", False),
    ("refused", "refused", "rejected", False),
    ("bad_output", "bad_output", "bad_output", False),
)


def route(clauses: Column, cached: Column, has_key: Column, chars: Column, allowed: Column, deny_reason: Column) -> Column:
    """The first of these that holds decides; `model` means that the reader is asked."""
    return (
        F.when(clauses == 0, "no_clauses").when(cached, "cache").when(~has_key, "demo_mode").when(chars > CALL_CHARS, "too_long").when(clauses > CALL_CLAUSES, "too_many_clauses")
        .when(~allowed, F.when(deny_reason == "visitor", "visitor_limit").otherwise("budget_spent")).otherwise("model")
    )


def status_kind(status: Column) -> Column:
    """The kind of an HTTP failure."""
    return F.when(status.isin(429, 529), "busy").when(status.isin(400, 401, 403, 404), "config").otherwise("upstream")


def failure(opened: Column, status: Column, error: Column, past_deadline: Column, stop_reason: Column, is_json: Column) -> Column:
    """What a call's event log amounts to, null if it gave an answer. error: http, connect, timeout, lost or event."""
    return (
        F.when(past_deadline | (error == "timeout"), "incomplete:timeout")
        .when(~opened & (error == "http"), F.concat(F.lit("unavailable:"), status_kind(status)))
        .when(~opened & (error == "connect"), "unavailable:network")
        .when(error.isin("lost", "event", "http", "connect"), "incomplete:interrupted")
        .when(stop_reason == "refusal", "refused").when((stop_reason == "max_tokens") | ~is_json, "bad_output")
    )


def outcome_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(OUTCOMES), "failure string, notice string, error string, refunded boolean")


def with_outcome(calls: DataFrame, report: tuple = ("used", "remaining", "visitor_remaining", "limit")) -> DataFrame:
    """calls (failure, used, remaining, visitor_remaining, limit) with notice, error and the report after a refund."""
    used, remaining, visitor, limit = (F.col(c) for c in report)
    rows = calls.join(F.broadcast(outcome_table(calls.sparkSession)), "failure", "left")
    back = F.coalesce(F.col("refunded"), F.lit(False))
    return rows.withColumns({
        report[0]: F.when(back, F.greatest(F.lit(0), used - 1)).otherwise(used),
        report[1]: F.when(back, F.least(limit, remaining + 1)).otherwise(remaining),
        report[2]: F.when(back, visitor + 1).otherwise(visitor),
    })


def prompts(segments: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id and the numbered text that a reader is given."""
    line = F.when(F.col("kind") == "heading", F.concat(F.lit("§ "), neutralised(F.col("body")))).otherwise(F.concat(F.lit("["), F.col("clause_id").cast("string"), F.lit("] "), neutralised(F.col("body"))))
    own = segments.withColumn("_line", line).groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct("seg_no", "_line"))).alias("_l"), F.count_if(F.col("kind") == "clause").alias("_n"), F.coalesce(F.min("clause_id"), F.lit(1)).alias("_first")
    )
    closing = F.format_string("Annotate clauses %d to %d: %d entries, one per clause.", F.col("_first"), F.col("_first") + F.col("_n") - 1, F.col("_n"))
    return own.select(id_col, F.concat_ws("\n", F.lit("<document>"), F.transform("_l", lambda x: x["_line"]), F.lit("</document>"), closing).alias("prompt"))


def ask(requests: DataFrame, reader: Callable[[str], dict], id_col: str = "doc_id") -> DataFrame:
    """id, failure, output (JSON) and model of each prompt. The reader is any callable; an error of one row is that row's failure.

    It returns {"text": .., "model": .., "stop_reason": ..}, or raises with a
    `kind` attribute that names one of OUTCOMES.
    """
    id_type = requests.schema[id_col].dataType.simpleString()

    def one(prompt: str) -> tuple:
        try:
            reply = reader(prompt)
        except Exception as e:  # the boundary: whatever a reader raises is data here
            return getattr(e, "kind", "unavailable:upstream"), None, None
        if reply.get("stop_reason") == "refusal":
            return "refused", None, reply.get("model")
        try:
            json.loads(reply["text"])
        except (ValueError, KeyError, TypeError):
            return "bad_output", None, reply.get("model")
        return ("bad_output", None, reply.get("model")) if reply.get("stop_reason") == "max_tokens" else (None, reply["text"], reply.get("model"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [one(p) for p in frame["prompt"]]
            yield pd.DataFrame({id_col: frame[id_col], "failure": [r[0] for r in rows], "output": [r[1] for r in rows], "model": [r[2] for r in rows]})

    return requests.select(id_col, "prompt").mapInPandas(run, f"{id_col} {id_type}, failure string, output string, model string")
