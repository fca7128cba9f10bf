"""Language-model scores by prediction by partial matching, beside a unigram baseline.

The model is the trie of all byte contexts of up to ORDER (two) bytes with the
counts of what followed them in the training texts; it has at most 2^24 leaves,
whatever the corpus. A byte not seen in the longest context is escaped to the
next shorter one (escape method C: as many escapes as different bytes seen), and
bytes seen in the longer context are excluded from the shorter one's counts.
Both depend on the context alone, so the code length of every (context, byte)
is computed once, and a document's score is a sum of table entries.

A deeper trie (the registered query takes DEEP bytes of context) has no such
bound. Its counts are a table in buckets by the three nearest bytes of context,
so that all that orders three and up need of each other is in one bucket; orders
up to two come from the bounded table. Documents are dealt into chunks of CHUNK
bytes; a chunk's different codes go to the buckets in packed arrays, get their
lengths there and meet the chunk's documents again in one task, so nobody holds
the whole trie.

The baseline needs the count of every token of the corpus. The counts of the
most frequent tokens are in a table of fixed size on every executor; all other
tokens are joined to the full counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, fold, stored, table

ORDER, LEAVES = 2, 1 << 24
#: Bytes of context of the registered query; bytes of text whose codes are looked up together; buckets of the trie at least, and bytes of text to a bucket.
DEEP, CHUNK, BUCKETS, TO_BUCKET = 5, 32 << 20, 1024, 16 << 20
FOLDS, HELD_OUT = 7, 2
#: Slots of the table of frequent tokens, and how many of the most frequent are offered a slot.
SLOTS, FREQUENT = 1 << 21, 1 << 20
#: Bytes of text that are looked at together; tokens that a task holds before it hands counts on.
TOGETHER, HELD = 4 << 20, 3_000_000
#: Stands for the end token: no word hashes to it but with a chance of 2^-64.
END = 0x5EED0E7D


def token_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a lower-cased text, and the end."""
    words = text.split()
    out = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.append(out, np.uint64(END)).view(np.int64)


def leaf_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of context and byte at every place of all texts, each with an end byte 0; and where a text's codes begin and end.

    Before a text stand two bytes 0, so the codes between two texts mean nothing.
    """
    data = np.frombuffer(b"\0\0" + b"\0\0\0".join(texts) + b"\0", np.uint8)
    codes = data[:-2].astype(np.uint32) << np.uint32(16)
    codes |= data[1:-1].astype(np.uint32) << np.uint32(8)
    codes |= data[2:]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(size + 3)[:-1])) if len(size) else size
    return codes, starts, starts + size + 1


def portions(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    held, weight = [], 0
    for t in texts:
        held.append(t)
        weight += len(t)
        if weight >= TOGETHER:
            yield held
            held, weight = [], 0
    if held:
        yield held


def code_windows(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """leaf_codes() of the texts; a text longer than TOGETHER comes alone, window after window. Last: number of texts begun."""
    if len(texts) > 1 or len(texts[0]) <= TOGETHER:
        long = [i for i, t in enumerate(texts) if len(t) > TOGETHER]
        if not long:
            yield (*leaf_codes(texts), len(texts))
            return
        for t in texts:
            yield from code_windows([t])
        return
    text = b"\0\0" + texts[0] + b"\0"
    for at in range(2, len(text), TOGETHER):
        data = np.frombuffer(text[at - 2 : at + TOGETHER], np.uint8).astype(np.uint32)
        codes = data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]
        yield codes, np.array([0]), np.array([len(codes)]), int(at == 2)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(leaf, key, n): counts of tokens (leaf false) and of trie leaves (true) of a task's texts."""

    def rows(leaf: bool, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), leaf)), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["leaf", "key", "n"])

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(place, np.concatenate([n for _, n in parts])).astype(np.int64)

    leaves, parts, held = np.zeros(LEAVES, np.uint32), [], 0
    for b in batches:
        for texts in portions((x.as_py() or "").encode("utf-8", "surrogatepass").translate(LOWER) for x in b.column(0)):
            for codes, starts, ends, _ in code_windows(texts):
                if len(starts) > 1:
                    gaps = (ends[:-1, None] + np.arange(2)).ravel()
                    codes = np.delete(codes, gaps)
                seen, n = np.unique(codes, return_counts=True)
                leaves[seen] += n.astype(np.uint32)
            parts.append(np.unique(np.concatenate([token_hashes(t) for t in texts]), return_counts=True))
            held += len(parts[-1][0])
            if held > HELD:
                parts = [summed(parts)]
                held = len(parts[0][0])
                if held > HELD // 2:
                    yield rows(False, *parts[0])
                    parts, held = [], 0
    seen = np.flatnonzero(leaves)
    yield rows(True, seen, leaves[seen])
    if parts:
        yield rows(False, *summed(parts))


def code_lengths(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 of the probability (float32) of every leaf, by its code, from the counts of the seen ones."""
    c2 = np.zeros(LEAVES, np.float64)
    c2[keys] = n
    c2 = c2.reshape(256, 256, 256)
    c1 = c2.sum(axis=0)
    c0 = c1.sum(axis=0)

    def share(counts: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        return np.divide(counts, total + kinds, out=np.zeros(np.broadcast_shapes(counts.shape, total.shape)), where=total + kinds > 0)

    def escape(total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """A context that has nothing left to offer is passed for free."""
        return np.divide(kinds, total + kinds, out=np.ones(np.shape(total)), where=total + kinds > 0)

    new1 = c1 == 0  # context b, byte s
    n0 = (c0 * new1).sum(axis=1, keepdims=True)
    d0 = ((c0 > 0) & new1).sum(axis=1, keepdims=True).astype(float)
    never = max(1, int((c0 == 0).sum()))
    low = np.where(c0 > 0, share(np.broadcast_to(c0, (256, 256)), n0, d0), escape(n0, d0) / never)
    out = np.empty((256, 256, 256), np.float32)
    for a in range(256):
        own = c2[a]
        total, kinds = own.sum(axis=1, keepdims=True), (own > 0).sum(axis=1, keepdims=True).astype(float)
        new2 = own == 0
        n1 = (c1 * new2).sum(axis=1, keepdims=True)
        d1 = ((c1 > 0) & new2).sum(axis=1, keepdims=True).astype(float)
        lower = np.where(c1 > 0, share(c1, n1, d1), escape(n1, d1) * low)
        out[a] = np.log10(np.maximum(np.where(new2, escape(total, kinds) * lower, share(own, total, kinds)), 1e-30))
    return out.ravel()


def deep_windows(texts: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """As code_windows(), for `order` bytes of context; in a code the nearest byte of context comes first and the byte itself last."""

    def codes_of(data: np.ndarray) -> np.ndarray:
        codes = data[order:].astype(np.int64)
        for j in range(1, order + 1):
            codes |= data[order - j : len(data) - j].astype(np.int64) << (8 * (order + 1 - j))
        return codes

    before = bytes(order)
    short = [t for t in texts if len(t) <= TOGETHER]
    if len(short) == len(texts):
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(size + order + 1) - (size + order + 1)
        yield codes_of(np.frombuffer(before + (b"\0" + before).join(texts) + b"\0", np.uint8)), starts, starts + size + 1, len(texts)
        return
    for t in texts:
        text = before + t + b"\0"
        for at in range(order, len(text), TOGETHER):
            codes = codes_of(np.frombuffer(text[at - order : at + TOGETHER], np.uint8))
            yield codes, np.array([0]), np.array([len(codes)]), int(at == order)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(place, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with their chunk: about CHUNK bytes of a task's texts."""
    from pyspark import TaskContext

    first, before = TaskContext.get().partitionId() << 32, 0
    for b in batches:
        size = pc.fill_null(pc.cast(pc.binary_length(b.column("text")), pa.int64()), 0).to_numpy(zero_copy_only=False) + 1
        ends = before + np.cumsum(size)
        chunk = first + (ends - size) // CHUNK
        before = int(ends[-1]) if len(ends) else before
        yield pa.RecordBatch.from_arrays([pa.array(chunk), *b.columns], names=["chunk", *b.schema.names])


def runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of the stretches of rows that are equal in all columns."""
    if len(columns[0]):
        new = np.zeros(len(columns[0]) - 1, bool)
        for c in columns:
            new |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(columns[0])]
        yield from zip(cuts, cuts[1:])


def pack(a: np.ndarray) -> bytes:
    """The array's bytes by place in the number, compressed; its length before them."""
    return len(a).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes(), "zstd", asbytes=True)


def unpack(b: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    data = np.frombuffer(pa.decompress(b[8:], n * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(data.reshape(size, n).T).reshape(-1).view(kind)


def deep_counts(order: int, buckets: int):
    """Rows of three kinds: counts of the tokens (0) and leaves of order two (1) of training texts by key, and packed codes of a chunk and bucket (2), n = 0 where only held-out texts of it have them."""
    kinds = {"kind": pa.int32(), "key": pa.int64(), "n": pa.int64(), "chunk": pa.int64(), "bucket": pa.int32(), "codes": pa.binary(), "counts": pa.binary()}

    def rows(size: int, **own) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(own[k], t) if k in own else pa.nulls(size, t) for k, t in kinds.items()], names=list(kinds))

    def counted(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return rows(len(keys), kind=np.full(len(keys), kind), key=keys, n=n)

    def packed(chunk: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        near = keys >> (8 * (order - 1)) << 8 | keys & 255
        yield counted(1, *summed([(near[n > 0], n[n > 0])]))
        bucket = ((keys >> (8 * (order - 2))).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % buckets
        by = np.argsort(bucket, kind="stable")
        keys, n, bucket = keys[by], n[by], bucket[by]
        cuts = list(runs(bucket))
        size = len(cuts)
        yield rows(size, kind=[2] * size, chunk=[chunk] * size, bucket=bucket[[at for at, _ in cuts]], codes=[pack(np.diff(keys[at:end], prepend=0)) for at, end in cuts], counts=[pack(n[at:end]) for at, end in cuts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, codes, tokens = None, [], []
        for b in batches:
            chunk = b.column("chunk").to_numpy()
            held_out = b.column("held_out").to_numpy(zero_copy_only=False)
            for at, end in runs(chunk):
                if now is not None and chunk[at] != now and codes:
                    yield from packed(now, *summed(codes))
                    codes = []
                now = int(chunk[at])
                column = b.column("text").slice(at, end - at)
                for kind in (False, True):
                    own = column.filter(pa.array(held_out[at:end] == kind))
                    for texts in portions((x.as_py() or "").encode("utf-8", "surrogatepass").translate(LOWER) for x in own):
                        for found, starts, ends, _ in deep_windows(texts, order):
                            if len(starts) > 1:
                                found = np.delete(found, (ends[:-1, None] + np.arange(order)).ravel())
                            keys, n = np.unique(found, return_counts=True)
                            codes.append((keys, n * (not kind)))
                        if not kind:
                            tokens.append(np.unique(np.concatenate([token_hashes(t) for t in texts]), return_counts=True))
                        if sum(len(k) for k, _ in codes) > HELD:
                            codes = [summed(codes)]
                        if sum(len(k) for k, _ in tokens) > HELD:
                            tokens = [summed(tokens)]
                            if len(tokens[0][0]) > HELD // 2:
                                yield counted(0, *tokens[0])
                                tokens = []
        if codes:
            yield from packed(now, *summed(codes))
        if tokens:
            yield counted(0, *summed(tokens))

    return run


class LowOrders:
    """What orders up to two know, from the counts of the leaves of order two (codes as of deep_windows())."""

    def __init__(self, keys: np.ndarray, n: np.ndarray) -> None:
        by = np.argsort(keys)
        self.keys, self.n = keys[by], n[by].astype(np.float64)
        context = self.keys >> 8
        self.total, self.kinds = np.bincount(context, self.n, 1 << 16), np.bincount(context, minlength=1 << 16).astype(float)
        self.lengths = code_lengths(self.turned(self.keys), self.n)

    @staticmethod
    def turned(codes: np.ndarray) -> np.ndarray:
        """The code with the two bytes of context in the order of the text."""
        return (codes >> 8 & 255) << 16 | (codes >> 16) << 8 | codes & 255

    def counts(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(codes))
        at = np.minimum(np.searchsorted(self.keys, codes), len(self.keys) - 1)
        return np.where(self.keys[at] == codes, self.n[at], 0.0)

    def escaped(self, codes: np.ndarray) -> np.ndarray:
        """log10 of the probability of a byte that isn't in the context of order two, once that is escaped."""
        total, kinds = self.total[codes >> 8], self.kinds[codes >> 8]
        return self.lengths[self.turned(codes)] - np.log10(np.divide(kinds, total + kinds, out=np.ones(len(codes)), where=kinds > 0))


def deep_lengths(keys: np.ndarray, n: np.ndarray, order: int, low: LowOrders) -> np.ndarray:
    """log10 of the probability of different codes, with all codes seen of the same three nearest bytes of context among them.

    What a context has seen, each shorter one has seen as well, so the bytes
    excluded after an escape are those of the last context alone: the shorter
    one's total is less by its own counts of these bytes, its kinds by their number.
    """
    out, left = np.zeros(len(keys)), np.ones(len(keys), bool)
    off_total, off_kinds = np.zeros(len(keys)), np.zeros(len(keys))

    def shorter(codes: np.ndarray, by: int) -> np.ndarray:
        return codes >> (8 * (by + 1)) << 8 | codes & 255

    def step(count: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> None:
        nonlocal left
        total, kinds = total - off_total, kinds - off_kinds
        here = left & (count > 0)
        out[here] += np.log10(count[here] / (total + kinds)[here])
        left = left & ~here
        pass_ = left & (kinds > 0)  # a context that has nothing left to offer is passed for free
        out[pass_] += np.log10(kinds[pass_] / (total + kinds)[pass_])

    def level(k: int) -> tuple:
        leaf, at = np.unique(shorter(keys, order - k), return_inverse=True)
        return leaf, at, np.bincount(at, n, len(leaf))

    own = level(order)
    for k in range(order, 2, -1):
        leaf, at, count = own
        context, of = np.unique(leaf >> 8, return_inverse=True)
        total, kinds = np.bincount(of, count, len(context)), np.bincount(of, count > 0, len(context))
        step(count[at], total[of][at], kinds[of][at])
        below = shorter(leaf, 1)
        if k > 3:
            own = level(k - 1)
            fewer = own[2][np.searchsorted(own[0], below)]
        else:
            fewer = low.counts(below)
        off_total, off_kinds = np.bincount(of, fewer * (count > 0), len(context))[of][at], kinds[of][at]
    codes = shorter(keys, order - 2)
    step(low.counts(codes), low.total[codes >> 8], low.kinds[codes >> 8])
    out[left] += low.escaped(codes[left])
    return out


class Lookup:
    """Values by key: a table of slots, and a search for the keys that have lost their slot to another."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values = keys, values  # sorted by key
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.at = np.zeros(1 << self.bits, np.int32)
        self.at[self.slot(keys)] = np.arange(len(keys), dtype=np.int32)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self.at[self.slot(keys)]
        lost = np.flatnonzero(self.keys[at] != keys)
        at[lost] = np.searchsorted(self.keys, keys[lost])
        return self.values[at]


def frequent_table(keys: np.ndarray, n: np.ndarray, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """By slot (the lowest bits of a hash) the most frequent token of it and its count; a count of 0 is no token."""
    order = np.lexsort((keys, n))
    keys, n = keys[order], n[order]
    at = keys & (slots - 1)
    held, count = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    held[at], count[at] = keys, n  # the last, most frequent one stays
    return held, count


def least_frequent(tokens: DataFrame, most: int = FREQUENT) -> int:
    """A count that at most `most` tokens reach. Counts are tallied in steps of a sixteenth of an octave, so nothing is sorted."""
    step = F.floor(F.log2("n") * 16)
    tally = sorted(tokens.groupBy(step.alias("step")).agg(F.count(F.lit(1)), F.min("n")).collect(), reverse=True)  # a few hundred rows
    least, held = 1 << 62, 0
    for _, n, low in tally:
        held += n
        if held > most:
            break
        least = low
    return least


def between(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum from each start to its end; starts rise, no stretch is empty. Each is summed on its own, so it doesn't depend on the others."""
    stretches = np.column_stack((starts, ends)).ravel()
    return np.add.reduceat(np.append(values, 0.0).astype(np.float64), stretches)[::2]


class Scores:
    """Rows of all documents of a task: kind 0 has what is known of a document, kind 1 a token that is still to be joined."""

    names = ["row", "id", "held_out", "n_tokens", "n_known", "base", "score", "token"]

    def __init__(self, lengths, held, count, first_row: int, windows=code_windows) -> None:
        self.lengths, self.held, self.logs, self.count, self.next, self.windows = lengths, held, np.log10(count + 1.0), count, first_row, windows

    def batch(self, ids: pa.Array, held_out: pa.Array, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        scores: list[float] = []
        for codes, starts, ends, begun in self.windows(texts):
            own = between(self.lengths[codes], starts, ends).tolist()
            if begun:
                scores += own
            else:
                scores[-1] += own[0]
        tokens = [token_hashes(t) for t in texts]
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        token = np.concatenate(tokens)
        slot = token & (len(self.held) - 1)
        known = (self.held[slot] == token) & (self.count[slot] > 0)
        ends = np.cumsum(size)
        total = between(np.where(known, self.logs[slot], 0.0), ends - size, ends)
        seen = np.concatenate(([0], np.cumsum(known)))
        rows = np.arange(self.next, self.next + len(texts))
        self.next += len(texts)
        kinds = [pa.int64(), ids.type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
        n = len(texts)
        whole = [pa.array(rows), ids, held_out, pa.array(size), pa.array(seen[ends] - seen[ends - size]), pa.array(total), pa.array(scores), pa.nulls(n, pa.int64())]
        yield pa.RecordBatch.from_arrays(whole, names=self.names)
        rest = ~known
        m = int(rest.sum())
        open_ = [pa.array(np.repeat(rows, size)[rest]), *(pa.nulls(m, k) for k in kinds[1:7]), pa.array(token[rest])]
        yield pa.RecordBatch.from_arrays(open_, names=self.names)


def rows_schema(id_type: str) -> str:
    return f"row long, id {id_type}, held_out boolean, n_tokens long, n_known long, base double, score double, token long"


def token_totals(tokens: DataFrame) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Number of tokens and of different ones, and the table of the frequent ones."""
    total, kinds = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    often = tokens.where(F.col("n") >= least_frequent(tokens)).toArrow()  # at most FREQUENT rows
    return total, kinds, *frequent_table(often["key"].to_numpy(), often["n"].to_numpy())


def low_rows(own: DataFrame, id_type: str) -> tuple[DataFrame, DataFrame, int, int]:
    """Rows of Scores by the bounded trie, token counts, and their totals."""
    counted = own.where(~F.col("held_out")).select("text").mapInArrow(_counts, "leaf boolean, key long, n long")
    counts = stored(counted.groupBy("leaf", "key").agg(F.sum("n").alias("n")), "counts")
    tokens = counts.where("not leaf").select("key", "n")
    total, kinds, held, count = token_totals(tokens)
    leaves = counts.where("leaf").select("key", "n").toArrow()  # at most LEAVES rows
    lengths = code_lengths(leaves["key"].to_numpy(), leaves["n"].to_numpy())
    del leaves
    shared = own.sparkSession.sparkContext.broadcast((lengths, held, count))  # 96 MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        scores = Scores(*shared.value, TaskContext.get().partitionId() << 40)
        for b in batches:
            at = 0
            for texts in portions((x.as_py() or "").encode("utf-8", "surrogatepass").translate(LOWER) for x in b.column("text")):
                part = b.slice(at, len(texts))
                at += len(texts)
                yield from scores.batch(part.column("id"), part.column("held_out"), texts)

    return stored(own.mapInArrow(run, rows_schema(id_type)), "scores"), tokens, total, kinds


def deep_rows(own: DataFrame, id_type: str, order: int) -> tuple[DataFrame, DataFrame, int, int]:
    """As low_rows(), by contexts of up to `order` bytes."""
    spark_context = own.sparkSession.sparkContext
    dealt = stored(own.mapInArrow(_dealt, f"chunk long, id {id_type}, held_out boolean, text string"), "dealt", compression="zstd")
    size = dealt.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    raw = dealt.select("chunk", "held_out", "text").mapInArrow(deep_counts(order, max(BUCKETS, size // TO_BUCKET)), "kind int, key long, n long, chunk long, bucket int, codes binary, counts binary")
    raw = stored(raw, "codes", compression="zstd")
    counts = stored(raw.where("kind < 2").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    tokens = counts.where("kind = 0").select("key", "n")
    total, kinds, held, count = token_totals(tokens)
    leaves = counts.where("kind = 1").select("key", "n").toArrow()  # at most LEAVES rows
    low = spark_context.broadcast(LowOrders(leaves["key"].to_numpy(), leaves["n"].to_numpy()))
    often = spark_context.broadcast((held, count))
    del leaves, held, count

    def lengths_of(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        found = [np.cumsum(unpack(codes, np.int64)) for _, codes, _ in rows]
        keys, place = np.unique(np.concatenate(found), return_inverse=True)
        n = np.bincount(place, np.concatenate([unpack(n, np.int64) for *_, n in rows]), len(keys))
        lengths = deep_lengths(keys, n, order, low.value).astype(np.float32)[place]
        own = np.split(lengths, np.cumsum([len(f) for f in found])[:-1])
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array(map(pack, own), pa.binary())], names=["chunk", "codes", "lengths"])

    def model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; whole buckets are taken together."""
        kept, last, held = [], None, 0
        for b in batches:
            for bucket, *row in zip(*(b.column(c).to_pylist() for c in ("bucket", "chunk", "codes", "counts"))):
                if bucket != last and held > HELD // 8:
                    yield lengths_of(kept)
                    kept, held = [], 0
                kept.append(row)
                last, held = bucket, held + int.from_bytes(row[1][:8], "little")
        if kept:
            yield lengths_of(kept)

    packed = raw.where("kind = 2").select("bucket", "chunk", "codes", "counts").repartition("bucket").sortWithinPartitions("bucket")
    looked = packed.mapInArrow(model, "chunk long, codes binary, lengths binary")
    looked = looked.select("*", F.lit(None).cast(id_type).alias("id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("string").alias("text"))
    whole = looked.union(dealt.select("chunk", F.lit(None).cast("binary"), F.lit(None).cast("binary"), "id", "held_out", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A chunk's codes come first, then its documents."""
        from pyspark import TaskContext

        scores = Scores(None, *often.value, TaskContext.get().partitionId() << 40, lambda texts: deep_windows(texts, order))
        now, parts = None, []
        for b in batches:
            chunk, document = b.column("chunk").to_numpy(), pc.is_null(b.column("codes")).to_numpy(zero_copy_only=False)
            for at, end in runs(chunk, document):
                if chunk[at] != now:
                    now, parts, scores.lengths = chunk[at], [], None
                own = b.slice(at, end - at)
                if not document[at]:
                    parts += [(np.cumsum(unpack(k.as_py(), np.int64)), unpack(v.as_py(), np.float32)) for k, v in zip(own.column("codes"), own.column("lengths"))]
                    continue
                if scores.lengths is None:
                    keys, lengths = map(np.concatenate, zip(*parts))
                    by = np.argsort(keys)
                    scores.lengths, parts = Lookup(keys[by], lengths[by]), []
                begun = 0
                for texts in portions((x.as_py() or "").encode("utf-8", "surrogatepass").translate(LOWER) for x in own.column("text")):
                    part = own.slice(begun, len(texts))
                    begun += len(texts)
                    yield from scores.batch(part.column("id"), part.column("held_out"), texts)

    met = whole.repartition("chunk").sortWithinPartitions("chunk", F.col("codes").isNull())
    return stored(met.mapInArrow(run, rows_schema(id_type)), "scores"), tokens, total, kinds


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT, order: int = ORDER) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs, by contexts of up to `order` (2 to 6) bytes.

    Only rows outside the held-out fold train (null ids are in fold 0). A null
    text is empty: it has the end token alone, and its score is that of an end
    at once. Without training rows each byte has probability 1/256 and every
    token's count is 0. Repeated rows train and are scored each. Tokens are
    counted by 64-bit hashes; a token's place among those of equal count changes
    no result. U+0000 in a text is the same symbol as the end. A text of any
    length is one row; one above TOGETHER bytes is looked at window by window. An
    empty table gives an empty result. Other columns aren't looked at.
    """
    own = docs.select(F.col(id_col).alias("id"), (fold(id_col, folds) == held_out).alias("held_out"), F.col(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    if order > 2:
        rows, tokens, total, kinds = deep_rows(own, id_type, order)
    else:
        rows, tokens, total, kinds = low_rows(own, id_type)
    rest = rows.where("token is not null").select(F.col("row").alias("_row"), "token").join(tokens, F.col("token") == F.col("key"), "left")
    rest = rest.groupBy("_row").agg(F.sum(F.when(F.col("n").isNotNull(), F.log10(F.col("n") + 1)).otherwise(0.0)).alias("more"), F.count("n").alias("known"))
    out = rows.where("token is null").join(rest, F.col("row") == F.col("_row"), "left")
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(total + kinds + 1)))
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score"
    )


def op8_ppm_score(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), order=DEEP)


def token_baseline(spark, sf_dir: str) -> DataFrame:
    """The part of the scores that SQL can express: all columns but the model's, the baseline's score to six places."""
    found = score(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def baseline_sql() -> str:
    """crc32 is worked out byte by byte from the ids' digits."""
    table_of = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table_of.append(i)
    step = f"xor(x >> 8, list_extract({table_of}, CAST(xor(x & 255, ascii(c)) + 1 AS BIGINT)))"
    crc = f"xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda x, c: {step.replace('ascii(c)', 'c')}), 4294967295)"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce({crc} % {FOLDS}, 0) = {HELD_OUT} AS held_out,
  list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), ' end') AS ws FROM documents),
w AS MATERIALIZED (SELECT rid, held_out, unnest(ws) AS t FROM d),
n AS MATERIALIZED (SELECT t, count(*) AS n FROM w WHERE NOT held_out GROUP BY t),
v AS (SELECT coalesce(sum(n), 0) AS total, count(*) AS kinds FROM n),
s AS (SELECT rid, count(*) AS n_tokens, count(n.n) AS n_known, sum(log10((coalesce(n.n, 0) + 1) / CAST(total + kinds + 1 AS DOUBLE))) AS base FROM w LEFT JOIN n USING (t), v GROUP BY rid)
SELECT doc_id, held_out, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(n_known AS BIGINT) AS n_known, CAST(total AS BIGINT) AS train_tokens, round(base, 6) AS base_score FROM d JOIN s USING (rid), v"""
