"""A query set against all vectors, in blocks of bounded size.

The vectors are written once and never shuffled again. Queries come in blocks
of bounded size, each sent to all executors; a task reads its share of the
vectors in blocks, prepares each block once for all queries of the block of
queries, and keeps the k best of every query, so a block of queries shuffles no
more than k rows a query and task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import new_path

#: Vectors and queries that meet at once at most, and the bytes that either may take.
ROWS, QUERIES, BYTES = 65536, 65536, 32 << 20


def usable(vectors: DataFrame, id_col: str, vector_col: str, nonzero: bool) -> DataFrame:
    """id and vector (array<double>) of the rows that take part: not null, of some length, all components finite, and not zero if asked for."""
    v = F.col("vector")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    own = own.where(~odd)
    return own.where(F.exists(v, lambda x: x != 0)) if nonzero else own


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.asarray(column.flatten())
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def by_length(rows: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, pa.Table | pa.RecordBatch]]:
    """The rows of each length of vector."""
    sizes = np.diff(np.asarray(rows["vector"].combine_chunks().offsets if isinstance(rows["vector"], pa.ChunkedArray) else rows["vector"].offsets))
    for d in np.unique(sizes).tolist():
        yield d, rows if (sizes == d).all() else rows.filter(pa.array(sizes == d))


def row_blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of at most `most` rows, or BYTES, of one length."""
    held: dict[int, list] = {}
    for b in batches:
        for d, part in by_length(b):
            room = max(1, min(most, BYTES // (8 * d)))
            for at in range(0, part.num_rows, room):
                cut = part.slice(at, room)
                own = held.setdefault(d, [])
                if sum(len(i) for i, _ in own) + cut.num_rows > room:
                    yield tuple(map(np.concatenate, zip(*own)))
                    own.clear()
                own.append((cut["id"].to_numpy(), matrix(cut["vector"])))
    for own in held.values():
        if own:
            yield tuple(map(np.concatenate, zip(*own)))


def merged(k: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query id, id, score) rows the k best of each query id, ties by smaller id; equal rows stay."""
    query, ids, scores = map(np.concatenate, zip(*parts))
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.empty(0, np.int64)
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.concatenate((first, [len(query)]))))
    return query[place < k], ids[place < k], scores[place < k]


def query_counts(vectors: DataFrame, every: int) -> tuple[int, int, int]:
    """Queries (ids divisible by `every`) of the stored vectors, different ids among them, and the longest vector's length."""
    own = vectors.where(F.col("id") % every == 0).agg(F.count(F.lit(1)), F.countDistinct("id"), F.coalesce(F.max(F.size("vector")), F.lit(1)))
    return tuple(own.first())


def block_search(vectors: DataFrame, asked: DataFrame, n: int, longest: int, k: int, prepare: Callable, score_type: str, rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of asked its k best rows of vectors but those of its own id.

    vectors (id, vector) is a stored table. asked (id, vector and what else the
    search needs) has n rows, with vectors of `longest` components at most, and
    goes in blocks of about `queries` rows or BYTES; more than one block is
    written by block first. prepare(ids, X) makes of a block of vectors a
    search(queries), which yields (query_id, ids, scores) with the best k of the
    block for each of a table of queries whose vectors have the same length,
    exact ties by smaller id. The driver holds one block of queries at a time,
    and so does a task beside one block of vectors and k rows for each query.
    """
    spark = vectors.sparkSession
    each = max(1, min(queries, BYTES // (8 * longest)))
    n_blocks = max(1, -(-n // each))
    kind = pa.int64() if score_type == "long" else pa.float64()
    schema = f"query_id long, vec_id long, score {score_type}"

    def job(block: pa.Table) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)  # `each` queries, or BYTES

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked_by_length = dict(by_length(sent.value))
            best: list = []
            held = 0
            for ids, x in row_blocks(batches, rows):
                if x.shape[1] not in asked_by_length:
                    continue
                for query, found, scores in prepare(ids, x)(asked_by_length[x.shape[1]]):
                    best.append((np.full(len(found), query), found, scores))
                    held += len(found)
                if held > 2 * k * sent.value.num_rows + 1024:
                    best = [merged(k, best)]
                    held = len(best[0][0])
            if best:
                query, found, scores = merged(k, best)
                yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(found, pa.int64()), pa.array(scores).cast(kind)], names=["query_id", "vec_id", "score"])

        return vectors.select("id", "vector").mapInArrow(run, schema)

    if n_blocks == 1:
        best = job(asked.toArrow())
    else:
        dealt = asked.withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.lit(n_blocks)).cast("int"))
        path, out = new_path(spark, "queries"), new_path(spark, "nearest")
        dealt.repartition("block").write.partitionBy("block").parquet(path)
        for block in range(n_blocks):
            own = spark.read.schema(dealt.schema).parquet(path).where(F.col("block") == block).drop("block").toArrow()
            job(own).write.mode("append").parquet(out)
        best = spark.read.schema(schema).parquet(out)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    if len(ids) > 4 * k:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= limit)
    else:
        some = np.arange(len(ids))
    return some[np.lexsort((ids[some], -scores[some]))][:k]
