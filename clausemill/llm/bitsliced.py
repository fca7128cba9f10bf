"""Exact top-k by integer inner product over a bit-sliced index.

A block of vectors is indexed by attribute: the component, less its minimum in
the block and without its lowest SHIFT bits, as one bitmap per remaining bit. A
query's score is a sum of shifted slices: its components are written in signed
digits, slices of negative digits enter complemented, and carry-save adders
reduce the slices of each weight to one, which are the slices of the score. Top
rows are then selected from the most significant slice downward. What the
dropped bits can add is bounded by the query, so the rows within that bound of
the k-th score are the boundary, and their exact scores decide.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import best_of, block_search, matrix, query_counts, usable
from .common import stored, table

SHIFT, K, EVERY = 3, 5, 50


def signed_digits(x: int) -> list[tuple[int, int]]:
    """(power of two, +1 or -1) with the fewest digits that sum to x."""
    out, at = [], 0
    while x:
        if x & 1:
            digit = 2 - (x & 3)
            out.append((at, digit))
            x -= digit
        x >>= 1
        at += 1
    return out


class BitSlicedIndex:
    """Slices (bitmaps of 64-bit words) of every attribute of one block of integer vectors."""

    def __init__(self, x: np.ndarray, shift: int = SHIFT) -> None:
        self.n, self.shift = x.shape[0], shift
        self.least = x.min(axis=0)
        high = (x - self.least) >> shift
        self.slices = []
        for d in range(x.shape[1]):
            column = high[:, d]
            self.slices.append([self._bitmap(column >> bit & 1) for bit in range(int(column.max()).bit_length())])
        self.all = self._bitmap(np.ones(self.n, np.int64))

    def _bitmap(self, bits: np.ndarray) -> np.ndarray:
        packed = np.packbits(bits.astype(np.uint8), bitorder="little")
        return np.pad(packed, (0, -len(packed) % 8)).view(np.uint64)

    def rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.n])

    def score_slices(self, q: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the approximate score, less a constant that is the same for all rows; and how much the dropped bits can add at most."""
        columns: dict[int, list[np.ndarray]] = {}
        for own, weight in zip(self.slices, q.tolist()):
            for power, digit in signed_digits(weight):
                for bit, bitmap in enumerate(own):
                    columns.setdefault(power + bit, []).append(bitmap if digit > 0 else bitmap ^ self.all)
        out, at, top = [], 0, max(columns, default=-1)
        zero = self.all ^ self.all
        while at <= top:
            column = columns.pop(at, [])
            carries = columns.setdefault(at + 1, [])
            while len(column) > 2:  # full adder
                a, b, c = column.pop(), column.pop(), column.pop()
                half = a ^ b
                column.append(half ^ c)
                carries.append((a & b) | (half & c))
            if len(column) == 2:
                a, b = column
                column = [a ^ b]
                carries.append(a & b)
            out.append(column[0] if column else zero)
            top = max(top, at + 1 if carries else top)
            at += 1
        return out, int(np.abs(q).sum()) * ((1 << self.shift) - 1)

    def candidates(self, q: np.ndarray, k: int) -> np.ndarray:
        """Rows among which the k highest scores surely are."""
        slices, slack = self.score_slices(q)
        if self.n <= k or not slices:
            return np.arange(self.n)
        chosen, open_rows, need, value = self.all ^ self.all, self.all, k, 0
        for bit in range(len(slices) - 1, -1, -1):
            ones = open_rows & slices[bit]
            n = int(np.bitwise_count(ones).sum())
            if n >= need:  # the k-th highest has this bit
                open_rows, value = ones, value | 1 << bit
            else:
                chosen, need, open_rows = chosen | ones, need - n, open_rows & ~slices[bit]
        # The k-th approximate score is `value`, in units of 2^shift. A row may be ahead of it if it is within the slack.
        floor = max(0, value - -(-slack >> self.shift) - 1)
        above, equal = self.all ^ self.all, self.all
        for bit in range(len(slices) - 1, -1, -1):
            if floor >> bit & 1:
                equal = equal & slices[bit]
            else:
                above, equal = above | (equal & slices[bit]), equal & ~slices[bit]
        return self.rows(above | equal)


def integers(floors: np.ndarray) -> list[list[int]]:
    return [[int(c) for c in row] for row in floors.tolist()]


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) as whole doubles; what isn't finite can't be made an integer and is an error later."""
    with np.errstate(over="ignore"):
        return np.floor(256.0 * x)


def search_block(k: int) -> Callable:
    def prepare(ids: np.ndarray, x: np.ndarray) -> Callable:
        """The index of one block. Rows and queries whose scores surely fit into 62 bits go by it, all others by Python's integers."""
        x = quantised(x)
        safe = math.isqrt((1 << 62) // x.shape[1])
        near = np.abs(x).max(axis=1) <= safe
        far_ids, far_x = ids[~near], integers(x[~near])
        near_ids, near_x = ids[near], x[near].astype(np.int64)
        index = BitSlicedIndex(near_x) if len(near_x) else None
        all_: list[list[int]] = []

        def search(queries: pa.Table) -> Iterator[tuple]:
            q = quantised(matrix(queries["vector"]))
            for query, row, plain in zip(queries["id"].to_pylist(), q, np.abs(q).max(axis=1) <= safe):
                if not plain and not all_:
                    all_.extend(integers(x))
                found, scores = ids[:0], np.zeros(0, np.int64)
                if plain and index:
                    weights = row.astype(np.int64)
                    own = int(np.count_nonzero(near_ids == query))  # rows of the query's id may be among the candidates
                    rows = index.candidates(weights, k + own)
                    rows = rows[near_ids[rows] != query]
                    scores = near_x[rows] @ weights
                    best = best_of(near_ids[rows], scores, k)
                    found, scores = near_ids[rows][best], scores[best]
                others, their_ids = (far_x, far_ids) if plain else (all_, ids)
                if others:
                    weights = [int(c) for c in row.tolist()]
                    more = [(sum(a * b for a, b in zip(v, weights)), i) for v, i in zip(others, their_ids.tolist()) if i != query]
                    ranked = sorted([*zip(scores.tolist(), found.tolist()), *more], key=lambda r: (-r[0], r[1]))[:k]
                    # A score of more than 64 bits is an error, as it is in SQL.
                    scores, found = np.array([r[0] for r in ranked], np.int64), np.array([r[1] for r in ranked], np.int64)
                yield query, found, scores

        return search

    return prepare


def exact_top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of the k highest integer inner products of each query, ties to the smaller id.

    Components are floor(256 * x), whatever their size; a score kept that needs
    more than 64 bits is an error. Queries are the rows whose id is divisible by
    `every`; rows of a null id, null vectors, empty ones and those with null or
    non-finite components take no part. A query meets only vectors of its
    length, and never a row of its own id. Rows equal in id and vector count once; differing
    vectors of an id are candidates, and queries, of their own, and the ranks of a
    query id are over what all of its vectors found, as in the SQL.
    """
    rows = stored(usable(vectors, id_col, vector_col, nonzero=False).dropDuplicates(["id", "vector"]), "vectors")
    n, _, longest = query_counts(rows, every)
    return block_search(rows, rows.where(F.col("id") % every == 0), n, longest, k, search_block(k), "long")


def op5_bit_sliced_topk(spark, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
