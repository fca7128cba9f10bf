import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from clausemill.llm import simhash
from clausemill.llm.simhash import bucket_links, components, fingerprint, fuzzy_keys, golay_keys, near_duplicates, one_of_each, walk_links

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: list of (id, fingerprint)."""
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(prints))]


def test_fingerprints():
    for text in (None, "", " \n", "One", "a b c", "a b c d", "A b C d e", "x" * 50 + " é ü z w q r", "a a a a a a a a"):
        assert fingerprint(text) == plain(text)
    long = " ".join(random.Random(1).choices("ab cd ef gh ij".split(), k=70_000))
    assert fingerprint(long) == plain(long)


def test_spark_hash_agrees(spark):
    assert spark.sql("select xxhash64('a b c d')").first()[0] & (2**64 - 1) == fingerprint("a b c d")


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 23, 4000)
    for flips in (0, 1, 2):
        y = x.copy()
        for _ in range(flips):
            y ^= 1 << rng.integers(0, 23, len(x))
        (a, n), (b, m) = golay_keys(x), golay_keys(y)
        for i in range(len(x)):
            assert set(a[i, : n[i]]) & set(b[i, : m[i]])


def test_every_pair_within_four_bits_shares_a_key():
    rng = random.Random(2)
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(1, 4)):
            b ^= 1 << bit
        keys = [set(fuzzy_keys(np.array([x], np.uint64))[1].tolist()) for x in (a, b)]
        assert keys[0] & keys[1]


def test_forest_and_refined_buckets_join_what_is_linked(monkeypatch):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    fp = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) & (2**64 - 1) for b in base for _ in range(40)})
    want = plain_components([(x, x) for x in fp])
    for found in (walk_links(np.array(fp, np.uint64)),):
        label = {x: x for x in fp}
        changed = True
        while changed:
            changed = False
            for a, b in found:
                low = min(label[a], label[b])
                changed |= label[a] != low or label[b] != low
                label[a] = label[b] = low
        assert [label[x] for x in fp] == want
    monkeypatch.setattr(simhash, "LARGE", 2)
    near = np.array([0, 1, 3, 1 << 63, (1 << 63) + 1], np.uint64)
    assert {frozenset(p) for p in bucket_links(6 << 40, near)} >= {frozenset((0, 1))}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(500, x) for x in range(501, 560)] + [(7, 7), (3, 2), (2, 3)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[i] == 500 for i in range(500, 560)) and got[3] == got[2] == 2
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def corpus():
    rng = random.Random(5)
    words = ["w%d" % i for i in range(400)]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(25)]
    rows = []
    for t in texts:
        rows.append(t)
        for _ in range(rng.randint(0, 6)):
            w = t.split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append(" ".join(w))
    rows += [None, "", "  ", "one", "One", "two three"]
    rng.shuffle(rows)
    return [(i * 3 % len(rows) if i else None, t, "k", 1.5) for i, t in enumerate(rows)] + [(5, rows[0], "k", 1.5)]


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, key double")
    got = sorted((r.doc_id is None, r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(df).collect())
    prints = [(d, plain(t)) for d, t, *_ in rows]
    want = sorted((d is None, d, f"{p:016x}", c) for (d, p), c in zip(prints, plain_components(prints)))
    assert got == want


def test_one_of_each_keeps_columns(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, doc double")
    kept = one_of_each(df)
    assert kept.columns == df.columns
    prints = [(d, plain(t)) for d, t, *_ in rows]
    assert kept.count() == len(set(plain_components([(i, p) for i, (_, p) in enumerate(prints)])))
    assert one_of_each(df.limit(0)).count() == 0 and near_duplicates(df.limit(0)).count() == 0


def test_very_long_text():
    rng = random.Random(8)
    text = " ".join(rng.choices("Alpha beta GAMMA é x1".split(), k=200_000))
    assert fingerprint(text) == plain(text)


def test_buckets_that_span_batches():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(0, 60))
        rows = sorted(set(zip(rng.integers(0, rng.integers(1, 8), n).tolist(), (rng.integers(0, 8, n) | rng.integers(0, 2, n) << 40).tolist())))
        cuts = [0, *sorted(rng.integers(0, len(rows) + 1, 3).tolist()), len(rows)]

        def links(parts):
            batches = (pa.RecordBatch.from_arrays([pa.array([k for k, _ in p], pa.int64()), pa.array([f for _, f in p], pa.int64())], names=["key", "fp"]) for p in parts)
            return {pair for b in simhash._links(batches) for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}

        assert links([rows[a:b] for a, b in zip(cuts, cuts[1:])]) == links([rows])
