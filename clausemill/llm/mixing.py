"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length within their source. Of the documents a
source still owes after whole passes over it, each length gives its share, and
the small budget that is then left is filled by a bounded-knapsack dynamic
programme over the lengths. Which documents of a length are taken is decided by
a seeded hash, so reruns agree.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered_rows, spread_rank, stored, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, CAP, SEED = 1.5, 2.0, 17
#: Words that the dynamic programme decides over at first; and up to how many this is widened where the budget isn't met.
CORE, WIDEST = 4096, 1 << 22


def fit(lengths: list[int], counts: list[int], budget: int, core: int = CORE) -> list[int]:
    """How many documents of each length to take, so that their words sum to the budget or come closest below it.

    lengths are distinct and positive. Proportional shares come first, then one
    more document of each length, longest first, while it fits. Documents are
    given back, shortest first, until about `core` words are open, and the
    bounded knapsack over all lengths that fit fills these exactly if any
    subset can. If none can, the open words are widened fourfold, up to WIDEST
    or all of the budget. So a budget of at most WIDEST words is met as nearly as
    any choice of documents can. Above that, the open words are filled as nearly
    as they can be; what is missing is less than the shortest document not taken.
    """
    total = sum(n * x for n, x in zip(counts, lengths))
    if budget >= total:
        return list(counts)
    take = [n * budget // total for n in counts]
    left = budget - sum(k * x for k, x in zip(take, lengths))
    falling = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    grown = True
    while grown:
        grown = False
        for i in falling:
            if take[i] < counts[i] and lengths[i] <= left:
                take[i] += 1
                left -= lengths[i]
                grown = True
    while True:
        for i in reversed(falling):
            while left < core // 2 and take[i] and lengths[i] + left <= core:
                take[i] -= 1
                left += lengths[i]
        more, open_ = knapsack([lengths[i] for i in falling], [counts[i] - take[i] for i in falling], left)
        if not open_ or left == budget or core >= WIDEST:
            break
        core = min(core * 4, WIDEST)
        if core >= budget:  # everything is given back
            take, left = [0] * len(take), budget
    for i, n in zip(falling, more):
        take[i] += n
    return take


def knapsack(lengths: list[int], counts: list[int], left: int) -> tuple[list[int], int]:
    """How many of each length come closest to `left` words from below, and the words that then stay open.

    Bit s of `reach` is set if s words can be had; a count is split into powers
    of two. `by` has the step that first had each sum: what it adds to was had before it.
    """
    reach, steps, full, by = 1, [], (1 << (left + 1)) - 1, np.full(left + 1, -1, np.int32)
    for i, length in enumerate(lengths):
        spare, part = min(counts[i], left // length), 1
        while spare > 0 and not reach >> left & 1:
            n = min(part, spare)
            new = reach << (n * length) & full & ~reach
            if new:
                low = (new & -new).bit_length() - 1
                bits = np.frombuffer((new >> low).to_bytes((new.bit_length() - low + 7) // 8, "little"), np.uint8)
                by[low + np.flatnonzero(np.unpackbits(bits, bitorder="little"))] = len(steps)
                reach |= new
            steps.append((i, n))
            spare, part = spare - n, part * 2
    at = reach.bit_length() - 1
    take, open_ = [0] * len(lengths), left - at
    while at:
        i, n = steps[by[at]]
        take[i] += n
        at -= n * lengths[i]
    return take, open_


def source_targets(sized: DataFrame, weights: tuple, share: float, cap: float) -> DataFrame:
    """(source, source_size, target): shares by the cycling weights, none above cap times its source, the excess reshared.

    Sources are numbered by a range-partitioned sort; the driver only sees the
    number of sources of each partition and sums.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = stored(
        totals.orderBy(F.col("source").asc_nulls_last())
        .withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "sources",
    )
    starts, n = [], 0
    for row in sorted(ordered.groupBy("_p").count().collect()):  # a row for each partition
        starts.append((row[0], n))
        n += row[1]
    start = F.create_map(*[F.lit(x).cast("long") for pair in starts or [(0, 0)] for x in pair])
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    place = F.col("_i") + start[F.col("_p").cast("long")]
    weighed = ordered.select("source", "source_size", cycle[F.pmod(place, F.lit(len(weights))).cast("int")].alias("w"))
    top = F.col("source_size") * F.lit(float(cap))
    total, level = share * (ordered.agg(F.sum("source_size")).first()[0] or 0), -1.0
    while True:
        capped = F.col("w") * F.lit(level) >= top
        held, open_w = weighed.agg(F.sum(F.when(capped, top).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("w")))).first()
        if not open_w:
            level = math.inf
            break
        higher = (total - held) / open_w
        if higher <= level:
            break
        level = higher
    target = top if math.isinf(level) else F.least(F.col("w") * F.lit(level), top)
    return weighed.select("source", "source_size", target.cast("double").alias("target"))


def _plans(pdf: pd.DataFrame) -> pd.DataFrame:
    rest = int(pdf["rest"].iloc[0])
    pdf = pdf.sort_values("size")
    some = pdf[pdf["size"] > 0]
    take = fit(some["size"].tolist(), some["n"].tolist(), rest) if rest > 0 and len(some) else [0] * len(some)
    out = some[["source", "size"]].assign(k=take)
    return pd.concat([out, pdf[pdf["size"] <= 0][["source", "size"]].assign(k=0)])


def mix(docs: DataFrame, id_cols: list[str], text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED, order_cols: list[str] | None = None) -> DataFrame:
    """id_cols, size, source_size, target, taken and copies of every row of docs.

    size: words of the text (null: 0). A source's target is its share of
    `share` times all words by its weight; no target is above `cap` times its
    source. copies: how often the mix takes the document whole; taken: copies
    times size. Null sources are one source, ordered last. A document without
    words is taken with every whole pass and adds nothing. Repeated rows are
    taken one by one. Which documents of a length are taken is decided by
    order_cols (else id_cols), so these must not depend on how the rows are
    dealt; rows equal in these are interchangeable. A text of any length is one
    row, whose words are counted in place. An empty table gives an empty result.
    Other columns, whatever their names, aren't looked at.
    """
    sized = stored(
        docs.select(*[F.col(c).alias(f"_id{i}") for i, c in enumerate(id_cols)], *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols or id_cols)], F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size")),
        "sizes",
    )
    whole = F.round(F.col("target")).cast("long")
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(whole / F.col("source_size")), F.lit(int(cap)))).otherwise(0).cast("int")
    sources = source_targets(sized, weights, share, cap).withColumn("passes", passes)
    sources = stored(sources.withColumn("rest", F.when(F.col("passes") < cap, whole - F.col("passes") * F.col("source_size")).otherwise(0).cast("long")), "targets")
    tally = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    owed = tally.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select("source", "size", "n", "rest")
    # A group has a row for each distinct length of the source: no more than its longest document has words.
    plan = owed.groupBy("source").applyInPandas(_plans, "source string, size long, k long")
    ids = [F.col(f"_id{i}") for i in range(len(id_cols))]
    ranked = spread_rank(sized, ["source", "size"], [F.lit(seed), *[F.col(f"_o{i}") for i in range(len(order_cols or id_cols))]], "_rank")
    plan = plan.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "k")
    rows = ranked.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))).drop("_s", "_z")
    rows = rows.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    copies = F.col("passes") + F.when(F.col("_rank") < F.col("k"), 1).otherwise(0)
    return rows.select(*[c.alias(name) for c, name in zip(ids, id_cols)], "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.cast("int").alias("copies"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of docs as the mix takes them: a row taken twice is there twice, one not taken is not.

    Columns stay as they are, also those named like the ones mix() adds. Row
    numbers change with the way a table is dealt, so which rows are taken goes
    by id and text; only among rows equal in both do the numbers decide.
    """
    numbered = numbered_rows(docs)
    own = numbered.select(F.col(f"doc.`{id_col}`").alias("id"), "row", F.col(f"doc.`{text_col}`").alias("text"), F.col(f"doc.`{source_col}`").alias("source"), F.xxhash64(F.col(f"doc.`{text_col}`")).alias("text_hash"))
    repeated = own.groupBy("id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("r_id"), F.col("text_hash").alias("r_hash"), F.lit(True).alias("again"))
    own = own.join(stored(repeated, "repeated"), F.col("id").eqNullSafe(F.col("r_id")) & (F.col("text_hash") == F.col("r_hash")), "left").withColumn("tie", F.when(F.col("again"), F.col("row")).otherwise(0))
    copies = mix(own, ["id", "row"], order_cols=["id", "text_hash", "tie"], **how).where("copies > 0").select(F.col("row").alias("taken_row"), "copies")
    taken = numbered.join(copies, F.col("row") == F.col("taken_row"))
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def op1_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), ["doc_id"])



def mix_targets(spark, sf_dir: str) -> DataFrame:
    """The part of the mix that SQL can express: doc_id, size, source_size and target of all documents."""
    return mix(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "size", "source_size", "target")


#: The level up to which sources are filled is that of the first source, by how soon it is full, which isn't full at it.
TARGETS_SQL = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * source_size AS top, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
l AS (SELECT top / w AS full_at, (total - coalesce(sum(top) OVER (ORDER BY top / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(w) OVER (ORDER BY top / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
x AS (SELECT arg_min(level, full_at) AS level FROM l WHERE level <= full_at)
SELECT d.doc_id, d.size, c.source_size, least(c.top, coalesce(c.w * x.level, c.top)) AS target FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source, x"""
