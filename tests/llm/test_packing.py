import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from clausemill.llm.packing import CAPACITY, Packing, TokenIds, best_fit, cross, cut, evolve, filled, fitness, lower_bound, pack, slots, start, tokenizer_paths
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def exact():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def total(genes):
    out = {}
    for pattern, n in genes:
        for x, m in pattern:
            out[x] = out.get(x, 0) + n * m
    return out


def test_ids_equal_the_tokenizer(exact):
    ids = TokenIds(*tokenizer_paths())
    for text in ["", " ", "  ", "a", " a", "a ", "a b", "a  b c", "a b\n c d", "a b \n\nc d  ", "It's we'll  x", "é ü ß 日本 語 x y", "x\x1c y z", " a b c", "a b <|endoftext|> c", "<|endoftext|>", " <|endoftext|><|endoftext|>\n a b c d", "x y<|endoftext|>z <|endoftext| a", "1234 5 6!? .. ,", "ab\tcd ef\rgh ij", "\n a b c\n"] * 2:
        assert np.frombuffer(ids(text), "<u4").tolist() == exact(text), text
    rng = random.Random(0)
    for _ in range(500):
        text = "".join(rng.choice(["a", "Bc", " ", " ", "\n", "'s", "9", "é", "<|endoftext|>", ".", "\t", "\x85", "　"]) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(ids(text), "<u4").tolist() == exact(text), repr(text)


def test_cut():
    assert cut(1, 4) == [(0, 1)] and cut(4, 4) == [(0, 4)] and cut(9, 4) == [(0, 1), (1, 4), (5, 4)] and cut(8, 4) == [(0, 4), (4, 4)]


def test_packings_hold_every_document_once():
    rng = random.Random(1)
    for _ in range(40):
        tally = {rng.randint(1, 100): rng.randint(1, 30) for _ in range(rng.randint(1, 40))}
        a, b = best_fit(tally, 100), best_fit(tally, 100, rng)
        for genes in (a, b, start(tally, 100, rng), cross(start(tally, 100, rng), b, tally, 100, rng), cross(a, b, tally, 100, rng), evolve(tally, 100, 3, [b])):
            assert total(genes) == tally and all(filled(p) <= 100 and n > 0 for p, n in genes)
        assert fitness(evolve(tally, 100, 3, [b])) >= max(fitness(a), fitness(b))


def test_best_fit_makes_few_patterns():
    tally = {x: 1_000_003 * x for x in range(1, 201)}
    assert len(best_fit(tally, 200)) <= 4 * 200


def fewest(lengths, capacity):
    """Sequences of an optimal packing, by trying all."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k, room in {r: k for k, r in enumerate(rooms) if r >= lengths[i]}.items():
            go(i + 1, [*rooms[:room], rooms[room] - lengths[i], *rooms[room + 1 :]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return best


def test_evolution_finds_optimal_packings_where_best_fit_does_not():
    rng = random.Random(3)
    better = 0
    for _ in range(250):
        lengths = [rng.randint(5, 26) for _ in range(rng.randint(6, 11))]
        tally = {x: lengths.count(x) for x in lengths}
        least, plain = fewest(lengths, 50), -fitness(best_fit(tally, 50))[0]
        found = -fitness(evolve(tally, 50, 1, [], population=8, generations=20))[0]
        assert lower_bound(tally, 50) <= least <= found <= plain
        assert found == least
        better += found < plain
    assert better > 3


def test_crossover_improves_on_its_parents():
    """Where the packings to start from miss the bound, those that the islands end with are fuller."""
    rng = random.Random(5)
    tally = {}
    for _ in range(300):
        x = rng.randint(400, 1000)
        tally[x] = tally.get(x, 0) + 1
    rng = random.Random(1)
    first = max([best_fit(tally, 2048), *(start(tally, 2048, rng) for _ in range(4))], key=fitness)
    assert fitness(evolve(tally, 2048, 1, [], generations=30)) > fitness(first)


def test_slots_are_gapless():
    tally = {7: 5, 3: 11, 10: 2}
    genes = best_fit(tally, 10)
    seen = {}
    for x, rows in slots(genes).items():
        ends = [*rows[1:, 0].tolist(), tally[x]]
        for (first, m, base, offset), end in zip(rows.tolist(), ends):
            for r in range(first, end):
                at = r - first
                seen.setdefault(base + at // m, []).append((offset + at % m * x, x))
    for places in seen.values():
        at = 0
        for offset, x in sorted(places):
            assert offset == at
            at += x
        assert at <= 10
    assert isinstance(Packing(10), Packing)


def test_pack_against_the_contract(spark, exact):
    rng = random.Random(2)
    texts = [None, "", "a", "a"] + [" ".join(rng.choices(["alpha", "Beta", "gamma,", "x\ny", "é"], k=rng.choice([3, 50, 700, 2000]))) for _ in range(60)]
    rows = [(i if i != 5 else None, t, i, "x") for i, t in enumerate(texts)] + [(1, "a b", 0, "y")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, length int, piece string")
    got = pack(df, with_ids=True).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t, *_ in rows[:-2]:
        if i == 1:
            continue
        want = exact(t or "") + [0]
        mine = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in mine] == [(k, s, n) for k, (s, n) in enumerate(cut(len(want), CAPACITY))]
        for r in mine:
            own = np.array(want[r.start : r.start + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(own) and bytes(r.ids) == own
    assert len(by_doc[1]) == 3
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= CAPACITY
    assert len(bins) <= 1 + max(-(-sum(r.length for r in got) // CAPACITY), sum(2 * r.length > CAPACITY for r in got))
    assert pack(df.limit(0)).count() == 0
