"""Tables that outlive a run: the cache of readings, the history of documents, the log, payloads and demo results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# What is admitted to the cache, and what a history keeps.
SHARE, KEPT, KEPT_CHARS = 0.8, 5, 1_500_000


def latest(cache: DataFrame) -> DataFrame:
    """Of each (text_sha256, pipeline) the row put last."""
    last = Window.partitionBy("text_sha256", "pipeline").orderBy(F.desc("created_at"), F.desc("analysis"))
    return cache.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def put(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """The cache with rows in place of those of equal keys."""
    return latest(cache.unionByName(rows))


def get(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests (text_sha256, pipeline, ..) with analysis (null: a miss). A stored text that isn't JSON is a miss."""
    sound = latest(cache).where(F.try_parse_json("analysis").isNotNull()).select("text_sha256", "pipeline", "analysis")
    return requests.join(sound, ["text_sha256", "pipeline"], "left")


def misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests that must be read: probed before the costly stage, once for each key."""
    sound = latest(cache).where(F.try_parse_json("analysis").isNotNull())
    return requests.join(sound, ["text_sha256", "pipeline"], "left_anti")


def admitted(readings: DataFrame) -> DataFrame:
    """Readings good enough to be kept: verified > 0 and at least 0.8 of the items and of the clauses."""
    return readings.where((F.col("verified") > 0) & (F.col("verified") >= SHARE * F.greatest("received", "clauses")))


def write_cache(cache: DataFrame, path: str) -> None:
    """Partitioned by the first two digits of the key, so a lookup reads 1/256."""
    cache.withColumn("shard", F.substring("text_sha256", 1, 2)).write.mode("overwrite").partitionBy("shard").parquet(path)


def history(documents: DataFrame, visitor_col: str = "visitor") -> DataFrame:
    """Of each visitor the newest 5 different documents, as long as their JSON sizes sum to at most 1.5 million; the newest always stays."""
    newest = Window.partitionBy(visitor_col, "key").orderBy(F.desc("ts"), F.desc("request_id"))
    once = documents.withColumn("_n", F.row_number().over(newest)).where("_n = 1")
    order = Window.partitionBy(visitor_col).orderBy(F.desc("ts"), F.desc("request_id"))
    rows = once.withColumn("place", F.row_number().over(order)).withColumn("_sum", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where((F.col("place") <= KEPT) & ((F.col("_sum") <= KEPT_CHARS) | (F.col("place") == 1))).drop("_n", "_sum")


def log_lines(results: DataFrame) -> DataFrame:
    """One JSON line a request, of eight fields; never the text."""
    fields = [F.lit("analyze").alias("event"), "chars", "clauses", F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("verified", F.lit(0)).alias("verified"), F.coalesce("dropped", F.lit(0)).alias("dropped"), "notice", "error"]
    return results.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def payloads(read_docs: DataFrame, pipeline: str, id_col: str = "doc_id") -> DataFrame:
    """id and the response of each document as JSON: text, key, pipeline, segments, readings with quotes, counters."""
    quoted = F.transform(
        "reading.readings",
        lambda r: F.struct(r["id"].alias("id"), F.transform(r["findings"], lambda f: F.struct(f["rule"].alias("rule"), f["favours"].alias("favours"), f["confidence"].alias("confidence"), f["reading"].alias("reading"), f["quote_start"].alias("quote_start"), f["quote_end"].alias("quote_end"), F.substring(F.col("text"), f["quote_start"] + 1, f["quote_end"] - f["quote_start"]).alias("quote"))).alias("findings")),
    )
    analysis = F.struct(quoted.alias("readings"), *[F.col(f"reading.{c}") for c in ("received", "verified", "dropped", "dropped_reasons", "relocated")])
    return read_docs.select(id_col, F.to_json(F.struct("text", "sha256", F.lit(pipeline).alias("pipeline"), F.col("reading.segments").alias("segments"), analysis.alias("analysis")), {"ignoreNullFields": "false"}).alias("payload"))


def read_labelled_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """slug, text and hand labels of a folder of <slug>.txt and <slug>.analysis.json."""
    slug = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)\.", 1)
    texts = spark.read.text(f"{folder}/*.txt", wholetext=True).select(slug.alias("slug"), F.col("value").alias("text"))
    shape = "clauses array<struct<id int, quote string, favours string, reading string, confidence string>>"
    labels = spark.read.schema(shape).option("multiLine", True).json(f"{folder}/*.analysis.json").select(slug.alias("slug"), "clauses")
    return texts.join(labels, "slug")
