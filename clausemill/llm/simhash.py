"""SimHash near-duplicates through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each
padded to the 23 bits of the perfect binary Golay code. The keys of a segment
are the message indices of all codewords within 4 bits of it: one, or six where
the nearest is 3 away. Two words at most 2 bits apart share a key, since the
codeword nearest to a word between them is within 3 bits of that and so within
4 of both.

Pigeonhole over 4 errors in three segments: either some segment has none, and
then one of the others has at most 2, or each has at least one, and then each
has at most 2. So two fingerprints that link share the exact bits of a segment
with a Golay key of another (6 ordered pairs), or Golay keys of both the first
and the second segment. Rows that share such a key are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, discard, numbered_rows, stored, table

WIDTHS = (22, 21, 21)
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, which generates the code.
GENERATOR = 0b101011100011
FAR, SHINGLE, SEED = 4, 4, 42
#: A bucket of this many rows is refined by the third segment first, or else searched by walking its links.
SMALL, LARGE = 8, 2048


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """Bit i is set if it is in over half of the XXH64 hashes of the k-word shingles, repeats included."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= k:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a long text takes no more memory than this
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(b.num_columns - 1)
        found = np.fromiter((fingerprint(x.as_py()) for x in texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found)], names=[*b.schema.names[:-1], "fp"])


@lru_cache(1)
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the high and low bits of a word, and by syndrome the error patterns of weight up to 4 and their number."""

    def syndrome(x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GENERATOR << (bit - 11)
        return x

    one = [syndrome(1 << b) for b in range(23)]
    errors, count = np.zeros((2048, 6), np.int32), np.zeros(2048, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = 0
            for b in bits:
                s ^= one[b]
            if weight < 4 or errors[s, 0].bit_count() == 3:
                errors[s, count[s]] = sum(1 << b for b in bits)
                count[s] += 1
    high = np.array([syndrome(x << 12) for x in range(2048)], np.int32)
    low = np.array([syndrome(x) for x in range(4096)], np.int32)
    return high, low, errors, count


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) message indices of the codewords within 4 bits of each 23-bit word, and how many of the 6 there are."""
    high, low, errors, count = golay_tables()
    s = high[words >> 12] ^ low[words & 4095]
    return (words[:, None].astype(np.int32) ^ errors[s]) >> 11, count[s]


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    out, shift = [], 0
    for width in WIDTHS:
        out.append((fp >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64))
        shift += width
    return out


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of every fingerprint (uint64)."""
    parts = _segments(fp)
    keys = [golay_keys(p) for p in parts]
    rows, out = [], []
    slot = np.arange(6)
    for tag, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        index, n = keys[j]
        r, c = np.nonzero(slot < n[:, None])
        rows.append(r)
        out.append(tag << 40 | parts[i][r] << 12 | index[r, c])
    (a, na), (b, nb) = keys[0], keys[1]
    r, c, d = np.nonzero((slot[:, None] < na[:, None, None]) & (slot[None, :] < nb[:, None, None]))
    rows.append(r)
    out.append(6 << 40 | a[r, c].astype(np.int64) << 12 | b[r, d])
    return np.concatenate(rows), np.concatenate(out)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fp), 8192):
            own = fp[at : at + 8192]
            rows, keys = fuzzy_keys(own.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own[rows])], names=["key", "fp"])


def walk_links(fp: np.ndarray, far: int = FAR) -> list[tuple[int, int]]:
    """A spanning forest of the links among fp (uint64, distinct): each reached fingerprint leaves the unseen ones at once."""
    out, unseen = [], fp
    while len(unseen):
        frontier, unseen = [unseen[0]], unseen[1:]
        while frontier and len(unseen):
            at = frontier.pop()
            near = np.bitwise_count(unseen ^ at) <= far
            if near.any():
                reached = unseen[near]
                out += [(int(at), int(x)) for x in reached]
                frontier += list(reached)
                unseen = unseen[~near]
    return out


def bucket_links(key: int, fp: np.ndarray) -> list[tuple[int, int]]:
    """The links of one bucket. A large one of two Golay keys is cut by the third segment's keys first, which loses no link of its kind."""
    if len(fp) < LARGE or key >> 40 != 6:
        return walk_links(fp)
    index, n = golay_keys(_segments(fp)[2])
    r, c = np.nonzero(np.arange(6) < n[:, None])
    third = index[r, c]
    order = np.argsort(third, kind="stable")
    cuts = np.flatnonzero(np.diff(third[order])) + 1
    out: set[tuple[int, int]] = set()
    for rows in np.split(r[order], cuts):
        if len(rows) > 1:
            out.update(walk_links(fp[rows]))
    return list(out)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; only the last bucket of a batch is carried on, as the parts that it came in."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []

    def search(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        fp = fp.view(np.uint64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1)) if len(key) else np.empty(0, np.int64)
        size = np.diff(np.concatenate((first, [len(key)]))) if len(key) else first
        a, b = [], []
        in_small = np.repeat((size > 1) & (size <= SMALL), size)
        k, f = key[in_small], fp[in_small]
        for step in range(1, SMALL):
            near = (k[step:] == k[:-step]) & (np.bitwise_count(f[step:] ^ f[:-step]) <= FAR)
            a.append(f[:-step][near])
            b.append(f[step:][near])
        for at, n in zip(first[size > SMALL], size[size > SMALL]):
            if found := bucket_links(int(key[at]), fp[at : at + n]):
                x = np.array(found, np.uint64)
                a.append(x[:, 0])
                b.append(x[:, 1])
        both = np.stack([np.concatenate(a or [f[:0]]), np.concatenate(b or [f[:0]])]).view(np.int64) if a else np.empty((2, 0), np.int64)
        both = np.unique(np.sort(both, axis=0), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    for batch in batches:
        key, fp = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        if not len(key):
            continue
        if kept and (key[-1] != kept[0][0][0] or key[0] != key[-1]):
            cut = int(np.searchsorted(key, key[-1]))
            yield search(*map(np.concatenate, zip(*kept, (key[:cut], fp[:cut]))))
            kept, key, fp = [], key[cut:], fp[cut:]
        elif not kept and key[0] != key[-1]:
            cut = int(np.searchsorted(key, key[-1]))
            yield search(key[:cut], fp[:cut])
            key, fp = key[cut:], fp[cut:]
        kept.append((key.copy(), fp.copy()))
    if kept:
        yield search(*map(np.concatenate, zip(*kept)))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b): root is the smallest node that it reaches.

    Alternating large and small stars. Each step only groups with partial sums
    and joins; a node of very many links is split by the join. The driver sees
    the number of links and one checksum.
    """
    # a: larger node, b: smaller
    stars = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    last = None
    while True:
        mark = tuple(stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if mark == last or not mark[0]:
            break
        last = mark
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).union(stars.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("_u")).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, "large")
        discard(stars)
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "_a")
        small = large.join(low, F.col("a") == F.col("_a"))
        small = small.select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        stars = stored(small, "small")
        discard(large)
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select("b", "b").distinct())


def near_links(prints: DataFrame) -> DataFrame:
    """(a, b): links between the distinct fingerprints of prints (fp) that join all that are linked; not every link is listed."""
    distinct = prints.select("fp").distinct()
    keyed = distinct.mapInArrow(_keyed, "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint and component_id of every row of docs.

    Null and empty texts, and texts of white space, have the fingerprint zero
    and link like others. component_id is the smallest id of the rows whose
    fingerprints are connected by links of at most 4 differing bits; null ids
    are passed over, and a group of only null ids has a null component_id.
    Repeated rows are in one component; ties play no part. A text of any length is
    one row, hashed by one task in portions. An empty table gives an empty
    result. Other columns aren't looked at.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    prints = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints, f"id {id_type}, fp long")
    prints = stored(prints, "fingerprints")
    least = prints.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(near_links(prints))
    # Classes of equal fingerprints without a link are their own component.
    classes = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    classes = stored(classes, "classes")
    whole = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = classes.join(whole, "root").select(F.col("fp").alias("_fp"), "component_id")
    out = prints.join(labels, F.col("fp") == F.col("_fp"))
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near copies, with all their columns: of each component the row of the smallest id stays, and of its repeats one.

    Null ids come last. Null and empty texts are near copies of each other, and
    of whatever has a fingerprint near zero. An empty table stays empty.
    """
    numbered = numbered_rows(docs)
    found = near_duplicates(numbered.select("row", F.col(f"doc.`{text_col}`").alias("text")), "row", "text").select(F.col("row").alias("r"), "component_id")
    ids = numbered.select("row", F.col(f"doc.`{id_col}`").alias("id"))
    kept = found.join(ids, F.col("row") == F.col("r")).groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "r")).alias("k"))
    return numbered.join(kept.select(F.col("k.r").alias("kept_row")), F.col("row") == F.col("kept_row"), "left_semi").select("doc.*")


def op2_simhash_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
