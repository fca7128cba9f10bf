import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from clausemill.llm import ppm
from clausemill.llm.ppm import LEAVES, code_lengths, frequent_table, leaf_codes, least_frequent, score

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


class Trie:
    """The model one symbol at a time."""

    def __init__(self, texts):
        self.seen = {}
        for t in texts:
            data = b"\0\0" + t + b"\0"
            for i in range(2, len(data)):
                for order in range(3):
                    self.seen.setdefault(data[i - order : i], Counter())[data[i]] += 1

    def log(self, context, byte):
        excluded, p = set(), 1.0
        for order in (2, 1, 0):
            left = {s: n for s, n in self.seen.get(context[2 - order :], {}).items() if s not in excluded}
            total, kinds = sum(left.values()), len(left)
            if byte in left:
                return math.log10(p * left[byte] / (total + kinds))
            if kinds:
                p *= kinds / (total + kinds)
            excluded |= set(left)
        return math.log10(p / (256 - len(excluded)))

    def score(self, t):
        data = b"\0\0" + t + b"\0"
        return sum(self.log(data[i - 2 : i], data[i]) for i in range(2, len(data)))


def documents():
    rng = random.Random(0)
    texts = [None, "", " ", "A", "é 日本"] + [" ".join(rng.choices(["The", "cat", "sat", "on", "ñandú", "x" * 20, "\n", "42"], k=rng.randint(1, 60))) for _ in range(80)]
    return [(i, t, "a", 1.0) for i, t in enumerate(texts)] + [(None, "The cat", "a", 1.0), (6, texts[6], "a", 1.0)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, token string, score double")


def fold(i):
    return 0 if i is None else zlib.crc32(str(i).encode()) % 7


def expected(rows):
    training = [low(t).encode() for i, t, *_ in rows if fold(i) != 2]
    trie = Trie(training)
    count = Counter()
    for i, t, *_ in rows:
        if fold(i) != 2:
            count.update(WORD.findall(low(t)))
            count[None] += 1
    total, kinds = sum(count.values()), len(count)
    out = []
    for i, t, *_ in rows:
        tokens = [*WORD.findall(low(t)), None]
        base = sum(math.log10((count[k] + 1) / (total + kinds + 1)) for k in tokens)
        out.append((i, fold(i) == 2, len(tokens), sum(count[k] > 0 for k in tokens), total, base, trie.score(low(t).encode())))
    return sorted(out, key=str)


@pytest.mark.parametrize("slots", [None, 4])
def test_against_brute_force(spark, monkeypatch, slots):
    rows = documents()
    if slots:  # nearly every token goes the way of the join, and long texts come in windows
        monkeypatch.setattr(ppm.frequent_table, "__defaults__", (slots,))
        monkeypatch.setattr(ppm, "TOGETHER", 64)
    got = sorted((tuple(r) for r in score(frame(spark, rows)).collect()), key=str)
    want = expected(rows)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (str(r[0]), r[6])), sorted(want, key=lambda r: (str(r[0]), r[6]))):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-5)


def test_probabilities_sum_to_one():
    codes, starts, ends = leaf_codes([b"abracadabra", b"abc abd", b""])
    own = np.concatenate([codes[a:b] for a, b in zip(starts, ends)])
    keys, n = np.unique(own, return_counts=True)
    p = 10.0 ** code_lengths(keys, n).reshape(65536, 256).astype(float)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)
    assert np.allclose(10.0 ** code_lengths(keys[:0], n[:0]).astype(float), 1 / 256, atol=1e-7) and len(p) * 256 == LEAVES


def test_frequent_tokens(spark):
    held, count = frequent_table(np.array([5, 13, 6]), np.array([2, 9, 1]), 8)
    assert held[5] == 13 and count[5] == 9 and held[6] == 6 and count[0] == 0
    df = spark.createDataFrame([(i, n) for i, n in enumerate([1] * 100 + [5] * 10 + [1000] * 3)], "key long, n long")
    assert least_frequent(df, 50) <= 5 and df.where(df.n >= least_frequent(df, 50)).count() == 13
    assert df.where(df.n >= least_frequent(df, 2)).count() == 0


def test_no_training_rows_and_empty(spark):
    held = next(i for i in range(100) if fold(i) == 2)
    r = score(frame(spark, [(held, "ab", None, None)])).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (2, 0, 0, 0.0) and r.score == pytest.approx(-3 * math.log10(256), rel=1e-5)
    assert score(frame(spark, documents()).limit(0)).count() == 0


class DeepTrie(Trie):
    """Contexts of any order, longest first."""

    def __init__(self, texts, order):
        self.order, self.seen = order, {}
        for t in texts:
            data = bytes(order) + t + b"\0"
            for i in range(order, len(data)):
                for k in range(order + 1):
                    self.seen.setdefault(data[i - k : i], Counter())[data[i]] += 1

    def log(self, context, byte):
        excluded, p = set(), 1.0
        for k in range(self.order, -1, -1):
            left = {s: n for s, n in self.seen.get(context[self.order - k :], {}).items() if s not in excluded}
            total, kinds = sum(left.values()), len(left)
            if byte in left:
                return math.log10(p * left[byte] / (total + kinds))
            if kinds:
                p *= kinds / (total + kinds)
            excluded |= set(left)
        return math.log10(p / (256 - len(excluded)))

    def score(self, t):
        data = bytes(self.order) + t + b"\0"
        return sum(self.log(data[i - self.order : i], data[i]) for i in range(self.order, len(data)))


@pytest.mark.parametrize("order, small", [(3, False), (5, False), (5, True), (6, False)])
def test_deep_trie_against_brute_force(spark, monkeypatch, order, small):
    rows = documents()
    if small:  # many chunks, long texts in windows, groups cut from batches
        for name, value in (("TOGETHER", 64), ("CHUNK", 500), ("HELD", 80)):
            monkeypatch.setattr(ppm, name, value)
    got = sorted((tuple(r) for r in score(frame(spark, rows), order=order).collect()), key=lambda r: (str(r[0]), r[2], r[6]))
    trie = DeepTrie([low(t).encode() for i, t, *_ in rows if fold(i) != 2], order)
    flat = score(frame(spark, rows)).collect()
    want = sorted(((i, trie.score(low(t).encode())) for i, t, *_ in rows), key=lambda r: (str(r[0]), r[1]))
    got.sort(key=lambda r: (str(r[0]), r[6]))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[6] for g in got] == pytest.approx([w[1] for w in want], rel=1e-5)
    assert sorted(map(str, (g[:5] for g in got))) == sorted(str(tuple(r)[:5]) for r in flat)


def test_registered_query_looks_further_than_two_bytes(spark, tmp_path):
    held = [i for i in range(200) if fold(i) == 2][:1]
    rows = [(i, "abcdx abcdx" if i % 2 else "zbcdy zbcdy", "a", 1.0) for i in range(200) if fold(i) != 2] + [(held[0], "abcdx abcdx", "a", 1.0)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.score for r in ppm.op8_ppm_score(spark, str(tmp_path)).collect()}
    assert got[held[0]] > score(frame(spark, rows)).where(f"doc_id = {held[0]}").first().score + 0.5  # what follows "bcd" depends on the byte before
