"""Packing documents into sequences: exact token ids, then a grouping genetic algorithm over lengths.

Documents of one length are alike to the packer, so a packing is a list of
genes: a pattern (lengths with their number in one sequence) and how many
sequences have it. It is as small for any number of documents, since a pass of
best fit makes at most four new patterns for each length up to the capacity.
Islands evolve such packings in separate tasks: crossover injects whole
well-filled genes of one parent, the other parent's sequences that would use a
document twice are dissolved, and the documents thus displaced go where they
fit best, after those that are longer have changed places with shorter ones. Elites move to the next island between epochs. The evolution ends at
once where a packing meets the lower bound.
"""

from __future__ import annotations

import base64
import json
import os
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_rank, stored, table

CAPACITY, END_ID = 2048, 0
#: Islands, packings on each, generations of an epoch at most and without a better packing, and epochs.
ISLANDS, POPULATION, GENERATIONS, STALLED, EPOCHS, SEED = 4, 4, 8, 4, 2, 11
#: Pieces of one length that are ranked together, in expectation, and the buckets of a length at most.
RANKED, MOST_BUCKETS = 1000, 4096
#: Lengths that are tried as one of three or four that fill a sequence.
TRIES = 64
#: Pieces of text whose ids a worker remembers, and the longest such piece.
REMEMBERED, LONGEST = 300_000, 48
#: One in so many pieces that aren't remembered is encoded twice.
COMPARED = 256

Pattern = tuple[tuple[int, int], ...]


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class TokenIds:
    """Ids (unsigned 32-bit little-endian bytes) of texts, equal to those of `tokenizers` with the vocabulary at json_path.

    Merging is done by tiktoken with the same vocabulary as ranks, several
    times faster. The first pieces of every worker, and of all others one in
    COMPARED by a hash, are compared with `tokenizers`, and a difference is an
    error. Strings of the vocabulary's
    added tokens give their ids wherever they stand, as they do there. A token
    never spans from another character to the white space after it, so a text
    is cut before single spaces, and the ids of short frequent pieces are
    remembered, up to REMEMBERED of them.
    """

    def __init__(self, json_path: str, ranks_path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.exact = Tokenizer.from_file(json_path)
        with open(json_path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("added tokens that take in what stands beside them aren't supported")
        self.added = {t["content"]: int(t["id"]).to_bytes(4, "little") for t in added}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.compared = 0
        outer = self

        class Known(dict):
            def __missing__(self, part: str) -> bytes:
                if not part or part[-1].isspace():
                    raise KeyError(part)
                ids = outer.direct(" " + part)
                if len(part) <= LONGEST:
                    if len(self) >= REMEMBERED:
                        self.clear()
                    self[part] = ids
                return ids

        self.known = Known()

    def direct(self, text: str) -> bytes:
        ids = self.fast(text)
        if self.compared < 200 or not zlib.crc32(text.encode("utf-8", "surrogatepass")) % COMPARED:
            self.compared += 1
            if ids != self.exact.encode(text, add_special_tokens=False).ids:
                raise ValueError("the ranks don't give the ids of the tokenizer")
        return np.array(ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self.marks and self.marks.search(text):
            return b"".join(self.added.get(part) or self.plain(part) for part in self.marks.split(text) if part)
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        parts = text.split(" ")
        if len(parts) < 3 or parts[0][-1:].isspace():
            return self.direct(text)
        try:
            inner = b"".join(map(self.known.__getitem__, parts[1:-1]))
        except KeyError:  # two white spaces in a row
            return self.direct(text)
        return self.direct(parts[0]) + inner + self.direct(" " + parts[-1])


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole ones of the capacity but for the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def token_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, with_ids: bool) -> DataFrame:
    """id, piece, start, length, ids_crc32 (and ids, binary, if asked for) of every piece of every document."""
    paths = tokenizer_paths()
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = TokenIds(*paths), END_ID.to_bytes(4, "little")
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, text in enumerate(part.column(1)):
                    own = encode(text.as_py() or "") + end
                    for k, (s, n) in enumerate(cut(len(own) // 4, capacity)):
                        cutting = own[4 * s : 4 * (s + n)]
                        row.append(i), piece.append(k), start.append(s), length.append(n), crc.append(zlib.crc32(cutting))
                        ids.append(cutting if with_ids else None)
                cols = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.binary())] * with_ids, names=["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    schema = f"id {id_type.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


class Packing:
    """Genes by the room that their sequences still have."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.mask = capacity, 0
        self.open: dict[int, list[list]] = {}

    def add(self, pattern: Pattern, room: int, n: int) -> None:
        if n:
            self.open.setdefault(room, []).append([pattern, n])
            self.mask |= 1 << room

    def place(self, length: int, n: int) -> None:
        """n documents of one length, each where it leaves the least room; new sequences where none has room."""
        while n:
            roomy = self.mask >> length
            if not roomy:
                each = self.capacity // length
                self.add(((length, each),), self.capacity - each * length, n // each)
                if n % each:
                    self.add(((length, n % each),), self.capacity - n % each * length, 1)
                return
            room = length + (roomy & -roomy).bit_length() - 1
            group = self.open[room].pop()
            if not self.open[room]:
                del self.open[room]
                self.mask &= ~(1 << room)
            pattern, have = group
            each = room // length
            used = min(have, n // each)
            self.add((*pattern, (length, each)), room - each * length, used)
            n -= used * each
            if used < have:
                if n:
                    self.add((*pattern, (length, n)), room - n * length, 1)
                self.add(pattern, room, have - used - bool(n))
                n = 0

    def exchange(self, left: dict[int, int]) -> None:
        """Documents of sequences with room change places with longer ones that are left over, as long as any sequence gets fuller by it.

        What is left over gets shorter that way, and so easier to place.
        """
        there = sum(1 << x for x, n in left.items() if n)
        work = [(room, group) for room in sorted(self.open) if room for group in self.open.pop(room)]
        self.mask &= 1
        while work:
            room, (pattern, n) = work.pop()
            gain, out, into = 0, 0, 0
            for x, _ in pattern:
                y = (there & ((2 << (x + room)) - 1)).bit_length() - 1
                if y - x > gain:
                    gain, out, into = y - x, x, y
            if not gain:
                self.add(pattern, room, n)
                continue
            k = min(n, left[into])
            changed = {into: 1}
            for x, m in pattern:
                changed[x] = changed.get(x, 0) + m
            changed[out] -= 1
            left[into] -= k
            there |= 1 << out
            there &= ~(int(not left[into]) << into)
            left[out] = left.get(out, 0) + k
            changed = tuple(sorted(((x, m) for x, m in changed.items() if m), reverse=True))
            if room > gain:
                work.append((room - gain, [changed, k]))
            else:
                self.add(changed, 0, k)
            if n > k:
                work.append((room, [pattern, n - k]))

    def genes(self) -> list[tuple[Pattern, int]]:
        merged: dict[Pattern, int] = {}
        for groups in self.open.values():
            for pattern, n in groups:
                runs: dict[int, int] = {}
                for x, m in pattern:
                    runs[x] = runs.get(x, 0) + m
                key = tuple(sorted(runs.items(), reverse=True))
                merged[key] = merged.get(key, 0) + n
        return sorted(merged.items())


def filled(pattern: Pattern) -> int:
    return sum(x * m for x, m in pattern)


def fitness(genes: list[tuple[Pattern, int]]) -> tuple[int, int]:
    """Fewer sequences first, then fuller ones."""
    return -sum(n for _, n in genes), sum(n * filled(p) ** 2 for p, n in genes)


def lower_bound(tally: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by all that is to be packed, and by documents of which no two fit together, for every length from which on the rest is counted."""
    by_length = np.zeros(capacity + 1, np.int64)
    by_length[list(tally)] = list(tally.values())
    half = capacity // 2
    count, size = np.cumsum(by_length), np.cumsum(by_length * np.arange(capacity + 1))
    best = max(-(-int(size[-1]) // capacity), int(count[-1] - count[half]))
    least = np.arange(1, half + 1)
    beside = capacity - least  # the longest with which one of the least length still fits
    room = (count[beside] - count[half]) * capacity - (size[beside] - size[half])
    small = size[half] - size[least - 1]
    more = np.maximum(0, -(-(small - room) // capacity))
    return max(best, int((count[-1] - count[half] + more).max(initial=0)))


def best_fit(tally: dict[int, int], capacity: int, rng: random.Random | None = None) -> list[tuple[Pattern, int]]:
    packing = Packing(capacity)
    order = sorted(tally, key=lambda x: -x * (1 + 0.15 * rng.random() if rng else 1))
    for length in order:
        packing.place(length, tally[length])
    return packing.genes()


def fill_up(packing: Packing, left: dict[int, int], rng: random.Random, tries: int = TRIES) -> None:
    """New sequences of up to four of the documents left over that fill them to the last place.

    Bit y of `there` is set if a document of length y is left, bit capacity - y
    of `mirror` likewise, so one shift and one conjunction find all pairs of a sum.
    """
    capacity = packing.capacity
    there = sum(1 << x for x, n in left.items() if n)
    mirror = sum(1 << (capacity - x) for x, n in left.items() if n)

    def highest(mask: int, odd: bool) -> int:
        low = mask & ((1 << rng.randrange(1, capacity + 1)) - 1) if odd else 0
        return (low or mask).bit_length() - 1

    def pair(room: int, odd: bool) -> tuple[int, ...]:
        """One or two lengths that fill the room."""
        if there >> room & 1:
            return (room,)
        found = there & (mirror >> (capacity - room)) & ((1 << room) - 1)
        return (y := highest(found, odd), room - y) if found else ()

    def completed(room: int) -> tuple[int, ...]:
        odd = rng.random() < 0.2
        if found := pair(room, odd):
            return found
        mask = there & ((1 << room) - 1)
        for _ in range(tries):
            if not mask:
                break
            y = highest(mask, odd)
            if rest := pair(room - y, odd):
                return (y, *rest)
            mask &= ~(1 << y)
        return ()

    for x in sorted(left, key=lambda x: -x * (1 + 0.02 * rng.random())):
        while left[x]:
            lengths = (x, *completed(capacity - x)) if x < capacity else (x,)
            if len(lengths) == 1 and x < capacity:
                break
            runs = sorted(((y, lengths.count(y)) for y in set(lengths)), reverse=True)
            n = min(left[y] // m for y, m in runs)
            if not n:  # one document can't be in two places
                break
            packing.add(tuple(runs), 0, n)
            for y, m in runs:
                left[y] -= n * m
                if not left[y]:
                    there &= ~(1 << y)
                    mirror &= ~(1 << (capacity - y))


def start(tally: dict[int, int], capacity: int, rng: random.Random) -> list[tuple[Pattern, int]]:
    """A packing to start from: sequences filled to the last place as long as there are such, then best fit."""
    left, packing = dict(tally), Packing(capacity)
    fill_up(packing, left, rng)
    for length in sorted(left, reverse=True):
        packing.place(length, left[length])
    return packing.genes()


def cross(a: list[tuple[Pattern, int]], b: list[tuple[Pattern, int]], tally: dict[int, int], capacity: int, rng: random.Random) -> list[tuple[Pattern, int]]:
    """Well-filled genes of b enter whole; sequences of a stay as far as their documents are left; the displaced are placed by best fit.

    Before that the displaced change places with shorter documents of sequences
    that have room, and make up what full sequences they can. As mutations, a
    share of a's sequences is dissolved, of the ill-filled ones most.
    """
    left = dict(tally)
    child = Packing(capacity)
    share, loose = rng.choice((0.01, 0.05, 0.2)), rng.choice((0.0, 0.01, 0.05))
    well = [g for g in b if filled(g[0]) == capacity] or sorted(b, key=lambda g: -filled(g[0]))[: -(-len(b) // 2)]
    entering = [g for g in well if rng.random() < share]
    for genes in (entering, sorted(a, key=lambda g: -filled(g[0]))):
        for pattern, n in genes:
            n = min(n, *(left[x] // m for x, m in pattern))
            if n and genes is not entering and rng.random() < (loose if filled(pattern) == capacity else 0.7):
                n -= rng.randint(1, n)
            for x, m in pattern:
                left[x] -= n * m
            child.add(pattern, capacity - filled(pattern), n)
    child.exchange(left)
    fill_up(child, left, rng)
    child.exchange(left)
    for length in sorted(left, reverse=True):
        child.place(length, left[length])
    return child.genes()


def evolve(tally: dict[int, int], capacity: int, seed: int, immigrants: list, population: int = POPULATION, generations: int = GENERATIONS) -> list[tuple[Pattern, int]]:
    """The best packing of one island: after `generations`, or STALLED of them without a better one, or at once where the bound is met."""
    rng = random.Random(seed)
    bound = lower_bound(tally, capacity)
    pool = [best_fit(tally, capacity), *immigrants]
    while len(pool) < population and -fitness(pool[0])[0] > bound:
        pool.append(start(tally, capacity, rng))
    best, since = max(map(fitness, pool)), 0
    for _ in range(generations):
        pool.sort(key=fitness, reverse=True)
        if -best[0] <= bound or since >= STALLED:
            break
        del pool[population:]
        pool += [cross(*rng.sample(pool, 2), tally, capacity, rng) if len(pool) > 1 else start(tally, capacity, rng) for _ in range(population)]
        reached = max(map(fitness, pool))
        best, since = (reached, 0) if reached > best else (best, since + 1)
    return max(pool, key=fitness)


def pack_lengths(spark, tally: dict[int, int], capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS, seed: int = SEED) -> list[tuple[Pattern, int]]:
    """The best packing of all islands. tally: documents by length; it has at most `capacity` entries."""
    bound = lower_bound(tally, capacity)
    elites: dict[int, list] = {}
    for epoch in range(epochs):
        came = {i: [elites[(i - 1) % islands]] if elites else [] for i in range(islands)}

        def run(frames: Iterator[pd.DataFrame], came=came, epoch=epoch) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for i in frame["id"]:
                    best = evolve(tally, capacity, seed + 1000 * epoch + int(i), came[int(i)])
                    yield pd.DataFrame({"island": int(i), "lengths": [[x for x, _ in p] for p, _ in best], "times": [[m for _, m in p] for p, _ in best], "n": [n for _, n in best]})

        rows = spark.range(0, islands, 1, islands).mapInPandas(run, "island long, lengths array<long>, times array<long>, n long").collect()  # genes: bounded by the capacity, not by the documents
        elites = {i: [] for i in range(islands)}
        for r in rows:
            elites[r.island].append((tuple(zip(r.lengths, r.times)), r.n))
        best = max(elites.values(), key=fitness)
        if -fitness(best)[0] <= bound:
            break
    return best


def slots(genes: list[tuple[Pattern, int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, documents of it in a sequence, first sequence, first offset), by rank."""
    out: dict[int, list] = {}
    seen: dict[int, int] = {}
    base = 0
    for pattern, n in genes:
        offset = 0
        for x, m in pattern:
            out.setdefault(x, []).append((seen.get(x, 0), m, base, offset))
            seen[x] = seen.get(x, 0) + n * m
            offset += x * m
        base += n
    return {x: np.array(rows, np.int64) for x, rows in out.items()}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id and offset (and ids, if asked for) of every piece of every row of docs.

    Null and empty texts are the end id alone. Documents above the capacity are
    cut into whole pieces but for the first. Repeated rows and null ids are
    packed like others, row by row; of rows equal in id and text each has a place
    of its own. A text of any length is one row and encoded by one task. An empty
    table gives an empty result.
    Other columns aren't looked at.
    """
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, id_col, text_col, capacity, with_ids), "pieces")
    # A piece of the whole capacity is a sequence of its own; its number needs no rank.
    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    pieces = pieces.where(F.col("length") < capacity)
    tally = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # less than `capacity` rows
    genes = pack_lengths(spark, tally, capacity) if tally else []
    # By the bound on genes, no more than four times the capacity for a pass of best fit, each of at most 63 runs.
    plan = spark.sparkContext.broadcast(slots(genes))
    buckets = min(MOST_BUCKETS, 1 + max(tally.values(), default=0) // RANKED)
    ranked = spread_rank(pieces, ["length"], [F.col("id"), F.col("piece")], "_rank", buckets)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                x = int(length[rows[0]])
                runs = plan.value[x]
                run = runs[np.searchsorted(runs[:, 0], rank[rows], side="right") - 1]
                place_in = rank[rows] - run[:, 0]
                sequence[rows] = run[:, 2] + place_in // run[:, 1]
                offset[rows] = run[:, 3] + place_in % run[:, 1] * x
            keep = [n for n in b.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in keep] + [pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema).union(full).withColumnRenamed("id", id_col)


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
