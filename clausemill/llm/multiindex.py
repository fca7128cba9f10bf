"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Vectors are extended so that the largest inner product is the smallest angle,
turned into principal axes, and rotated so that their signs lose least
(iterative quantisation on a bounded sample). The signs are the code. A code is
cut into substrings, each with an index of its own; by the pigeonhole principle
a code within the radius is within a substring's share of the radius in at least
one substring, so probing all values that near in every index retrieves every
code within the radius. Those are ranked again by the exact inner product.

Every query has a radius of its own: the one within which lie so many codes of
the sample that RECALL of the true neighbours within the sample are among them.
The sample is sparser than the table, so true neighbours in the table are
nearer, and the same radius holds more of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import best_of, block_search, by_length, matrix, query_counts, usable
from .common import stored, table

BITS, SUBSTRING = 256, 16
K, EVERY = 20, 20
#: Vectors that the rotation is fitted on at most (in expectation) of each length, and queries among them that set how many codes of the sample a radius holds.
SAMPLE, TRIALS, ROUNDS, RECALL, SEED = 8192, 256, 20, 0.95, 3
#: Values that a sampling hash is brought to.
WHOLE = 1 << 62


def distances(words: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Differing bits of each of n codes, given by word (BITS / 64, n), and one code."""
    out = np.bitwise_count(words[0] ^ code[0]).astype(np.uint16)
    for own, word in zip(words[1:], code[1:]):
        out += np.bitwise_count(own ^ word)
    return out


@dataclass
class Codes:
    projection: np.ndarray  # (components + 1) x BITS
    norm: float
    sample: np.ndarray  # codes by word
    held: int  # codes of the sample that a radius holds

    def of(self, x: np.ndarray, query: bool) -> np.ndarray:
        """(n, BITS / 64) words. Queries have no length to make up for; theirs doesn't matter."""
        squares = np.einsum("ij,ij->i", x, x)
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.norm**2 - squares))
        return np.packbits(np.column_stack((x, rest)) @ self.projection > 0, axis=1).view(np.uint64)

    def radius(self, code: np.ndarray) -> int:
        """The smallest radius around a query's code that holds enough of the sample; BITS if that is the whole sample."""
        if self.held >= self.sample.shape[1]:
            return BITS
        return int(np.partition(distances(self.sample, code), self.held - 1)[self.held - 1])


def learn(x: np.ndarray, norm: float, k: int = K) -> Codes:
    """x: a sample of vectors, none longer than norm."""
    rng = np.random.default_rng(SEED)
    x = x / (norm or 1.0)
    full = np.column_stack((x, np.sqrt(np.maximum(0.0, 1 - np.einsum("ij,ij->i", x, x)))))
    _, axes = np.linalg.eigh(full.T @ full)
    axes = axes[:, ::-1][:, :BITS]
    if axes.shape[1] < BITS:  # lifted to as many directions as there are bits
        axes = axes @ np.linalg.qr(rng.normal(size=(BITS, BITS)))[0][: axes.shape[1]]
    v = full @ axes
    turn = np.linalg.qr(rng.normal(size=(BITS, BITS)))[0]
    for _ in range(ROUNDS):
        u, _, w = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
        turn = w.T @ u.T
    codes = Codes(axes @ turn / (norm or 1.0), norm, np.empty((BITS // 64, 0), np.uint64), 0)
    codes.sample = np.ascontiguousarray(codes.of(x * norm, False).T)
    asked = codes.of(x[:TRIALS] * norm, True)
    # By query: how many of the sample's codes are as near as each of its true neighbours.
    places = []
    for i in range(len(asked)):
        scores = x @ x[i]
        scores[i] = -np.inf
        near = np.argsort(-scores)[: min(k, len(x) - 1)]
        far = distances(codes.sample, asked[i])
        places.append(np.searchsorted(np.sort(far), far[near], side="right"))
    if places and len(places[0]):
        codes.held = int(np.quantile(np.concatenate(places), RECALL, method="higher"))
    codes.held = max(codes.held, min(len(x), 2 * k))
    return codes


@lru_cache(32)
def _masks(errors: int) -> np.ndarray:
    values = np.arange(1 << SUBSTRING, dtype=np.uint16)
    return values[np.bitwise_count(values) <= errors] if errors >= 0 else values[:0]


class MultiIndex:
    """One index for each substring: rows by its value."""

    def __init__(self, codes: np.ndarray) -> None:
        self.words = np.ascontiguousarray(codes.T)
        parts = np.ascontiguousarray(codes.view(np.uint16).T)
        self.order = [np.argsort(c, kind="stable").astype(np.int32) for c in parts]
        self.starts = [np.concatenate(([0], np.cumsum(np.bincount(c, minlength=1 << SUBSTRING)))).astype(np.int32) for c in parts]
        self.values = [np.flatnonzero(np.diff(at)).astype(np.uint16) for at in self.starts]  # those that occur
        self.times = [np.diff(at)[v] for at, v in zip(self.starts, self.values)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows at most `radius` bits from code (BITS / 64 words)."""
        parts, values = len(self.order), code.view(np.uint16)
        seen = np.zeros(self.words.shape[1], bool)
        for s in range(parts):
            # The shares, each with its zero counted, sum to radius + 1: not every substring can be beyond its own.
            share = min(SUBSTRING, (radius + 1) // parts - 1 + (s < (radius + 1) % parts))
            masks, there = _masks(share), self.values[s]
            if len(there) < 8 * len(masks):  # fewer values to look at than to look up
                near = np.bitwise_count(there ^ values[s]) <= share
                seen[self.order[s][np.repeat(near, self.times[s])]] = True
                continue
            near = values[s] ^ masks
            at = self.starts[s][near]
            n = self.starts[s][near.astype(np.int32) + 1] - at
            if n.any():
                ends = np.cumsum(n)
                seen[self.order[s][np.arange(ends[-1]) + np.repeat(at - (ends - n), n)]] = True
        rows = np.flatnonzero(seen)
        return rows[distances(self.words[:, rows], code) <= radius]


def search_block(models: dict[int, Codes], k: int) -> Callable:
    def prepare(ids: np.ndarray, x: np.ndarray) -> Callable:
        index = MultiIndex(models[x.shape[1]].of(x, False))

        def search(queries: pa.Table) -> Iterator[tuple]:
            asked = np.frombuffer(b"".join(queries["code"].to_pylist()), np.uint64).reshape(queries.num_rows, -1)
            for query, q, code, radius in zip(queries["id"].to_pylist(), matrix(queries["vector"]), asked, queries["radius"].to_pylist()):
                rows = index.within(code, radius)
                rows = rows[ids[rows] != query]
                scores = (x[rows] * q).sum(axis=1)
                best = best_of(ids[rows], scores, k)
                yield query, ids[rows][best], scores[best]

        return search

    return prepare


def with_codes(queries: DataFrame, models: dict[int, Codes]) -> DataFrame:
    """id, vector, code and radius of each query."""
    shared = queries.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, part in by_length(b):
                codes = shared.value[d].of(matrix(part["vector"]), True)
                yield pa.RecordBatch.from_arrays([part["id"], part["vector"], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([shared.value[d].radius(c) for c in codes], pa.int32())], names=["id", "vector", "code", "radius"])

    return queries.mapInArrow(run, "id long, vector array<double>, code binary, radius int")


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of the k largest inner products found for each query, ties to the smaller id.

    Queries are the rows whose id is divisible by `every`. Rows of a null id,
    null, empty and zero vectors and those with null or non-finite components
    take no part. A query meets only vectors of its length and never a row of
    its own id; it gets k rows, or all there are: what is within its radius
    first, and where that is fewer than k, whatever the distance. Rows equal in
    id and vector count once; differing vectors of an id are candidates, and
    queries, of their own, and the ranks of a query id are over what all of its
    vectors found. Every row is indexed; only the rotation is fitted on a
    sample, whose size for each length of vectors is bounded by SAMPLE.
    """
    rows = usable(vectors, id_col, vector_col, nonzero=True).dropDuplicates(["id", "vector"])
    rows = stored(rows.select("id", "vector", F.size("vector").alias("d")), "vectors")
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    sizes = {r[0]: (r[1], r[2]) for r in rows.groupBy("d").agg(F.count(F.lit(1)), F.max(length)).collect()}  # a row for each vector length
    share = F.create_map(*[F.lit(x).cast("long") for d, (n, _) in sorted(sizes.items()) or [(0, (1, 0.0))] for x in (d, min(WHOLE, -(-WHOLE * SAMPLE // n)))])
    some = rows.where(F.pmod(F.xxhash64(F.lit(SEED), "id", "vector"), F.lit(WHOLE)) < share[F.col("d").cast("long")])
    sample: dict[int, list] = {}
    for r in some.collect():  # SAMPLE rows of each length, in expectation
        sample.setdefault(r.d, []).append((r.id, r.vector))
    models = {d: learn(np.array([v for _, v in sorted(own)], np.float64).reshape(-1, d), float(sizes[d][1]), k) for d, own in sample.items()}
    asked = with_codes(rows.where(F.col("id") % every == 0), models)
    n, n_ids, longest = query_counts(rows, every)
    found = stored(block_search(rows, asked, n, longest, k, search_block(models, k), "double"), "found")
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("_q"))
    if full.count() == n_ids:
        return found
    # Queries that got less than k, though there may be more: once more, whatever the distance.
    short = asked.join(full, F.col("id") == F.col("_q"), "left_anti").withColumn("radius", F.lit(BITS))
    again = block_search(rows, short, n, longest, k, search_block(models, k), "double")
    return found.join(full, F.col("query_id") == F.col("_q"), "left_semi").union(again)


def op10_multi_index_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
