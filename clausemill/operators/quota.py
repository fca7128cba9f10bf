"""The daily quota ledger over a table of requests: who is let through, and what is left."""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def decisions(requests: DataFrame, limit: int, per_visitor: int) -> DataFrame:
    """requests (request_id, ts, day, visitor) with reason (null if let through), used, remaining and visitor_remaining.

    The closed form of the ledger without refunds: a visitor's first
    `per_visitor` requests of a day are eligible (those without a visitor
    always), and the day is full once `limit` eligible ones have come. These
    first ones are found by a partial top-k; every request then counts, among
    the at most `limit` of its day, those before it. So no task reads all
    requests of a day, only those of one visitor.
    """
    cap = max(0, limit)
    who = F.coalesce(F.concat(F.lit("v"), "visitor"), F.concat(F.lit("r"), F.col("request_id").cast("string")))  # requests without a visitor aren't one group
    by_visitor = Window.partitionBy("day", "_who").orderBy("ts", "request_id")
    rows = requests.withColumn("_who", who).withColumn("_turn", F.row_number().over(by_visitor))
    rows = rows.withColumn("_able", F.col("visitor").isNull() | (F.col("_turn") <= per_visitor))
    in_turn = F.row_number().over(Window.partitionBy("day").orderBy("ts", "request_id"))
    first = rows.where("_able").select("day", "ts", "request_id").withColumn("_n", in_turn).where(F.col("_n") <= cap)
    first = first.groupBy(F.col("day").alias("_day")).agg(F.collect_list(F.struct("ts", "request_id")).alias("_first"))
    rows = rows.join(first, F.col("day").eqNullSafe(F.col("_day")), "left")
    earlier = F.filter("_first", lambda x: (x["ts"] < F.col("ts")) | (x["ts"] == F.col("ts")) & (x["request_id"] < F.col("request_id")))
    rows = rows.withColumn("_before", F.coalesce(F.when(F.col("_first").isNotNull(), F.size(earlier)), F.lit(0)).cast("long"))
    reason = F.when(F.col("_before") >= cap, "daily").when(~F.col("_able"), "visitor")
    rows = rows.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull())
    used = F.col("_before") + F.col("allowed").cast("long")
    # Units that the visitor has taken up to and with this request.
    taken = F.sum(F.col("allowed").cast("long")).over(by_visitor.rowsBetween(Window.unboundedPreceding, 0))
    visitor_used = F.when(F.col("visitor").isNull(), F.lit(0).cast("long")).otherwise(taken)
    none = F.lit(0).cast("long")
    return (
        rows.withColumn("used", used).withColumn("remaining", F.greatest(none, F.lit(cap) - F.col("used")))
        .withColumn("visitor_remaining", F.greatest(none, F.lit(per_visitor) - visitor_used)).drop("_who", "_turn", "_able", "_before", "_first", "_day")
    )


def day_status(decided: DataFrame, limit: int) -> DataFrame:
    used = F.count_if("allowed")
    return decided.groupBy("day").agg(F.count(F.lit(1)).alias("requests"), used.alias("used"), F.greatest(F.lit(0).cast("long"), F.lit(max(0, limit)) - used).alias("remaining"), F.count_if(F.col("reason") == "visitor").alias("visitor_denied"), F.count_if(F.col("reason") == "daily").alias("daily_denied"))


def visitor_status(decided: DataFrame, per_visitor: int) -> DataFrame:
    """used and remaining of each visitor and day."""
    used = F.count_if("allowed")
    return decided.where(F.col("visitor").isNotNull()).groupBy("day", "visitor").agg(used.alias("used"), F.greatest(F.lit(0).cast("long"), F.lit(per_visitor) - used).alias("remaining"))


def new_salts(spark: SparkSession, days: list[str]) -> DataFrame:
    """day and a random salt of 32 hexadecimal digits, drawn once a day, kept for that day and then forgotten."""
    return spark.createDataFrame([(d, secrets.token_hex(16)) for d in days], "day string, salt string")


def hmac_sha256(key: Column, message: Column) -> Column:
    """HMAC-SHA256 (hex) of text columns, from sha2 alone; the key is at most 64 bytes."""

    def padded(byte: int) -> Column:
        hexes = F.rpad(F.hex(key.cast("binary")), 128, "0")
        pairs = F.transform(F.sequence(F.lit(1), F.lit(127), F.lit(2)), lambda i: F.lpad(F.hex(F.conv(F.substring(hexes, i, F.lit(2)), 16, 10).cast("long").bitwiseXOR(F.lit(byte).cast("long"))), 2, "0"))
        return F.array_join(pairs, "")

    inner = F.sha2(F.concat(F.unhex(padded(0x36)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.unhex(padded(0x5C)), F.unhex(inner)), 256)


def visitor_name(salt: Column, client: Column) -> Column:
    """A visitor's pseudonym for one day; none without a client."""
    return F.when(F.length(client) > 0, F.substring(hmac_sha256(salt, client), 1, 32))
