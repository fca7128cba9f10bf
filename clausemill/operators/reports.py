"""What readers and operators are told: plans, provenance, spot checks, complete corpora, request and reply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import counted, model_name
from .analytics import GROUPS
from .parts import RETRYABLE

# The headers of an answer to an allowed origin.
CORS = {"access-control-allow-methods": "GET, POST, OPTIONS", "access-control-allow-headers": "content-type", "access-control-max-age": "600", "vary": "Origin"}


def cors_headers(origin: Column, allowed: Column) -> Column:
    """Headers (map) that let an allowed origin read the answer; an empty map for all others."""
    pairs = [x for name, value in CORS.items() for x in (F.lit(name), F.lit(value))]
    granted = F.create_map(F.lit("access-control-allow-origin"), origin, *pairs)
    return F.when((origin != "") & F.array_contains(allowed, origin), granted).otherwise(F.create_map().cast("map<string,string>"))


def can_be_retried(notice: Column) -> Column:
    return F.coalesce(notice.isin(*RETRYABLE), F.lit(False))


def readings_left(remaining: Column, visitor_remaining: Column) -> Column:
    """What a visitor may still ask for today; nothing where no budget is known."""
    return F.coalesce(F.least(remaining, F.coalesce(visitor_remaining, remaining)), F.lit(0))


def reading_plan(parts: DataFrame, left: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_parts, chars, left, enough and plan (a sentence) of documents split into parts (id, part_no, chars); left: id, left."""
    sizes = parts.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_parts"), F.sum("chars").alias("chars"))
    rows = sizes.join(left.select(id_col, "left"), id_col, "left").withColumn("left", F.coalesce("left", F.lit(0)))
    plan = F.concat(counted(F.col("chars"), "character"), F.lit(" in "), counted(F.col("n_parts"), "part"), F.lit("; "), counted(F.col("left"), "reading"), F.lit(" left"))
    return rows.withColumns({"enough": F.col("n_parts") <= F.col("left"), "plan": plan})


def provenance(parts: DataFrame, requested: str, id_col: str = "doc_id") -> DataFrame:
    """id and a sentence on who read a document's parts (part_no, source, model), which came from the cache, and whether another model stepped in.

    Models come in the order of their first parts; parts without a source were not read.
    """
    read = parts.where(F.col("source").isNotNull()).withColumn("model", F.coalesce("model", F.lit(requested)))
    by_model = read.groupBy(id_col, "model").agg(F.sort_array(F.collect_list("part_no")).alias("nos"))
    listed = F.concat(model_name(F.col("model")), F.lit(" ("), F.when(F.size("nos") == 1, "part ").otherwise("parts "), F.array_join(F.col("nos").cast("array<string>"), ", "), F.lit(")"))
    entry = F.struct(F.element_at("nos", 1).alias("first"), listed.alias("listed"), model_name(F.col("model")).alias("alone"))
    who = by_model.groupBy(id_col).agg(F.array_sort(F.collect_list(entry)).alias("who"))
    cached = F.col("source") == "cache"
    totals = parts.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(cached).alias("all_cached"), F.coalesce(F.bool_or(cached), F.lit(False)).alias("some_cached"),
        F.coalesce(F.bool_or(F.col("source").isNotNull() & (F.coalesce("model", F.lit(requested)) != requested)), F.lit(False)).alias("other"),
    )
    names = F.array_join(F.transform("who", lambda w: F.when(F.col("n") > 1, w["listed"]).otherwise(w["alone"])), " and ")
    seen = F.when(F.col("all_cached"), F.concat(F.lit("From the cache, read before by "), names)).otherwise(F.concat(F.lit("Read by "), names, F.when(F.col("some_cached"), ", in part from the cache").otherwise("")))
    sentence = F.when(F.col("who").isNull(), "Not read.").otherwise(F.concat(seen, F.lit("."), F.when(F.col("other"), " Another model answered where the first declined.").otherwise("")))
    return totals.join(who, id_col, "left").select(id_col, sentence.alias("provenance"))


def checklist_groups(checklist: DataFrame, catalogue: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of each document and side: its place among the groups, the kinds found with their first clauses, and how many of all kinds the document has."""
    kinds = F.lit(catalogue.count())  # one row for each rule
    entry = F.struct("place", F.concat(F.col("topic"), F.lit(" ¶ "), F.replace("first_ids", F.lit(","), F.lit(", ")), F.when(F.col("n_clauses") > F.size(F.split("first_ids", ",")), ", …").otherwise("")).alias("text"))
    groups = checklist.groupBy(id_col, "favours").agg(F.count(F.lit(1)).alias("n_kinds"), F.array_sort(F.collect_list(entry)).alias("e"))
    of_all = F.sum("n_kinds").over(Window.partitionBy(id_col))
    place = F.array_position(F.array(*[F.lit(g) for g in GROUPS]), F.col("favours"))
    return groups.select(id_col, place.cast("int").alias("place"), "favours", "n_kinds", F.array_join(F.col("e.text"), "; ").alias("found"), F.concat(of_all.cast("string"), F.lit(" of "), kinds.cast("string")).alias("of_all"))


def spot_check(expected: DataFrame, labels: DataFrame, skipped: int = 1) -> DataFrame:
    """outcome (same, none, different) and n: expected (sentence_no from 1, expected) against labels (clause_id, favours or null) by position, after `skipped` clauses of a preamble."""
    own = labels.select((F.col("clause_id") - skipped).alias("sentence_no"), "favours")
    outcome = F.when(F.col("favours").isNull(), "none").when(F.col("favours") == F.col("expected"), "same").otherwise("different")
    return expected.join(own, "sentence_no", "left").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def corpus_faults(report: DataFrame, clauses: DataFrame, placed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents of a labelled corpus that aren't perfect: quotes dropped or moved, or clauses without a reading."""
    read = placed.where(F.col("reason").isNull()).select(id_col, "clause_id").distinct()
    missing = clauses.join(read, [id_col, "clause_id"], "left_anti").groupBy(id_col).agg(F.sort_array(F.collect_list("clause_id")).alias("missing"))
    rows = clauses.select(id_col).distinct().join(report, id_col, "left").join(missing, id_col, "left")
    return rows.where((F.coalesce("dropped", F.lit(0)) > 0) | (F.coalesce("relocated", F.lit(0)) > 0) | F.col("missing").isNotNull()).select(id_col, "dropped", "relocated", "missing")


def require_none(faults: DataFrame, shown: int = 5) -> None:
    """An error that names the first few rows, if there are any."""
    if rows := faults.limit(shown).collect():
        raise ValueError(f"not complete: {[r.asDict() for r in rows]}")


def corpus_index(payloads: DataFrame, labels: DataFrame, id_col: str = "slug") -> DataFrame:
    """id, clauses, chars and tally (clauses by side, zeros included) of each document of payloads (id, text, clauses)."""
    sides = [F.count_if(F.col("favours") == f).alias(f) for f in ("you", "them", "neutral", "unclear")]
    tally = labels.groupBy(id_col).agg(F.struct(*sides).alias("tally"))
    zeros = F.struct(*[F.lit(0).cast("long").alias(f) for f in ("you", "them", "neutral", "unclear")])
    return payloads.join(tally, id_col, "left").select(id_col, "clauses", F.length("text").alias("chars"), F.coalesce("tally", zeros).alias("tally"))


def write_corpus(payloads: DataFrame, index: DataFrame, folder: str, id_col: str = "slug") -> None:
    """One JSON payload below <folder>/<id>=…/ for each document, and the index in one JSON file."""
    payloads.select(id_col, F.col("payload").alias("value")).write.mode("overwrite").partitionBy(id_col).text(f"{folder}/payloads")
    index.coalesce(1).write.mode("overwrite").json(f"{folder}/index")  # a row for each document of a hand-labelled corpus


def call_params(prompt: Column, model: str, max_tokens: int, system: str, schema: str, effort: str = "medium", fallbacks: bool = True) -> Column:
    """The parameters of one call of a reader, as JSON. schema: the JSON schema of its output."""
    message = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    rules = F.struct(F.lit("text").alias("type"), F.lit(system).alias("text"), F.struct(F.lit("ephemeral").alias("type")).alias("cache_control"))
    output = F.struct(F.lit(effort).alias("effort"), F.struct(F.lit("json_schema").alias("type"), F.parse_json(F.lit(schema)).alias("schema")).alias("format"))
    fields = [F.lit(model).alias("model"), F.lit(max_tokens).alias("max_tokens"), F.array(rules).alias("system"), F.array(message).alias("messages"), output.alias("output_config")]
    return F.to_json(F.struct(*fields, *([F.lit("default").alias("fallbacks")] if fallbacks else [])))


def reply_json(texts: Column) -> Column:
    """The JSON (a variant) in a reply's blocks of text: all of them joined, or else the last one; null if neither is JSON."""
    return F.coalesce(F.try_parse_json(F.array_join(texts, "")), F.try_parse_json(F.element_at(texts, -1)))


def deadlines(max_tokens: Column) -> Column:
    """Seconds until the call, the service and the client give up."""
    call = F.lit(60) + max_tokens / 50
    return F.struct(call.alias("call"), (call + 60).alias("service"), F.ceil(call + 60 + 30).alias("client"))


def cost_ceiling(calls: Column, max_tokens: Column, out_price: Column, in_tokens: Column, in_price: Column) -> Column:
    """What a day of `calls` can cost at most; prices are for a million tokens."""
    return calls * (max_tokens * out_price + in_tokens * in_price) / 1_000_000


def stepped(active: Column, delta: int, n: Column) -> Column:
    """The place (from 0) that a step from `active` leads to, around the end; from none (-1) to the first or last. Null without places."""
    start = F.lit(0) if delta > 0 else n - 1
    return F.when(n > 0, F.when(active < 0, start).otherwise(F.pmod(active + delta, n)))
