import math
import random

import numpy as np
import pytest
from clausemill.llm import blocks, multiindex
from clausemill.llm.bitsliced import BitSlicedIndex, exact_top_k, quantised, signed_digits
from clausemill.llm.multiindex import BITS, MultiIndex, learn, nearest


def vectors(spark, n=600, d=12, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=d).astype("float32").tolist(), 1, "x") for i in range(n)]
    rows[3] = (3, rows[7][1], 1, "x")  # ties
    rows[-1] = (n - 1, [0.0] * d, 1, "x")
    rows += [(n + 50, None, 1, "x"), (n + 100, [1.0, None] * (d // 2), 1, "x"), (n + 150, [float("nan")] * d, 1, "x"), (n + 200, [float("inf")] * d, 1, "x"), (None, [1.0] * d, 1, "x"), (n + 250, [], 1, "x")]
    rows += [(0, rows[0][1], 1, "x"), (7000, [1.0, 2.0], 1, "x"), (7001, [2.0, 1.0], 1, "x")]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score string")


def expected(rows, every, k, nonzero, score):
    ok = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (not nonzero or any(v)):
            ok[i] = np.array(v, np.float32).astype(float)
    out = []
    for q in ok:
        if q % every == 0:
            found = sorted((-score(ok[q], ok[i]), i) for i in ok if i != q and len(ok[i]) == len(ok[q]))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def test_signed_digits():
    for x in [*range(-300, 300), 2**20 + 7, -(2**21)]:
        assert sum(d << p for p, d in signed_digits(x)) == x


def test_candidates_hold_the_best():
    rng = np.random.default_rng(1)
    for shift in (0, 3, 6):
        for n, spread in ((1, 5), (40, 3), (1000, 150), (1000, 1)):
            x = rng.integers(-spread, spread + 1, (n, 9))
            q = rng.integers(-spread, spread + 1, 9)
            index = BitSlicedIndex(x, shift)
            scores = x @ q
            for k in (1, 6):
                limit = np.sort(scores)[-min(k, n)]
                assert set(np.flatnonzero(scores >= limit)) <= set(index.candidates(q, k))


def test_quantised_is_floor_of_any_size():
    assert quantised(np.array([-0.001, 0.5, -0.5, 1e4, -9e3, 1e30])).tolist() == [-1, 128, -128, 2_560_000, -2_304_000, 256e30]


@pytest.mark.parametrize("size", [(16384, 4096), (100, 3)])
def test_exact_top_k(spark, monkeypatch, size):
    rows, df = vectors(spark)
    monkeypatch.setattr(blocks.block_search, "__defaults__", size)
    got = sorted(map(tuple, exact_top_k(df).collect()))
    assert got == expected(rows, 50, 5, False, lambda a, b: int(np.floor(256 * a).astype(int) @ np.floor(256 * b).astype(int)))


@pytest.mark.parametrize("size, large", [(1e4, range(0, 120, 3)), (1e6, range(0, 120, 3)), (1e10, [3, 10, 77]), (1e10, [50])])
def test_large_components_are_not_clipped(spark, size, large):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=6) * (size if i in large else 1.0)).astype("float32").tolist()) for i in range(120)]
    got = sorted(map(tuple, exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()))
    assert got == expected(rows, 50, 5, False, lambda a, b: sum(math.floor(256 * float(x)) * math.floor(256 * float(y)) for x, y in zip(a, b)))


def test_a_score_of_more_than_64_bits_is_an_error(spark):
    df = spark.createDataFrame([(0, [1e30]), (1, [1e30])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="(?i)overflow|too large"):
        exact_top_k(df).collect()


def test_differing_vectors_of_an_id_all_count(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=6).astype("float32").tolist()) for i in range(1, 150)]
    rows += [(7, rng.normal(size=6).astype("float32").tolist()) for _ in range(40)] + [(50, rng.normal(size=6).astype("float32").tolist()) for _ in range(30)]
    df = spark.createDataFrame(rows + rows[-75:], "vec_id long, embedding array<float>")

    def best(q, k, score):
        found = [(-score(np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)), i) for j, a in rows if j == q for i, b in rows if i != q]
        return [(i, -s) for s, i in sorted(found)[:k]]

    for deal in (df, df.repartition(5), df.orderBy("embedding")):
        got = {}
        for r in sorted(exact_top_k(deal).collect()):
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert got == {q: best(q, 5, lambda a, b: int(np.floor(256 * a).astype(int) @ np.floor(256 * b).astype(int))) for q in (50, 100)}
    near = nearest(df).where("query_id in (20, 40)").collect()
    for q in (20, 40):
        own = sorted((r.rank, r.vec_id, r.score) for r in near if r.query_id == q)
        want = best(q, 20, lambda a, b: float(a @ b))
        assert len(own) == 20 and sum(i == 7 for _, i, _ in own) >= 2
        assert len({(i, round(s, 9)) for _, i, s in own} & {(i, round(s, 9)) for i, s in want}) >= 17


def test_every_code_within_the_radius_is_found():
    rng = np.random.default_rng(2)
    near = rng.integers(0, 1 << 63, (1, BITS // 64)).astype(np.uint64)
    codes = np.concatenate((rng.integers(0, 1 << 63, (1500, BITS // 64)).astype(np.uint64), near ^ (np.uint64(1) << rng.integers(0, 63, (500, BITS // 64)).astype(np.uint64))))
    index = MultiIndex(codes)
    for asked in (near[0], codes[0]):
        for radius in (0, 3, 4, 15, 16, 60, 101, 130, BITS):
            want = np.flatnonzero(np.bitwise_count(codes ^ asked).sum(axis=1) <= radius)
            assert index.within(asked, radius).tolist() == want.tolist()


def test_recall_where_the_table_is_larger_than_the_sample(spark, monkeypatch):
    rows, df = vectors(spark, 6000, 24)
    monkeypatch.setattr(multiindex, "SAMPLE", 400)
    want = {(r[0], r[2]) for r in expected([r for r in rows if r[0] is not None], 20, 20, True, lambda a, b: float(a @ b))}
    got = nearest(df).collect()
    assert len(got) == len(want) and len({(r.query_id, r.vec_id) for r in got} & want) / len(want) >= 0.9


def test_queries_with_too_few_codes_within_their_radius_get_all_the_same(spark, monkeypatch):
    def narrow(*how):
        model = learn(*how)
        model.held = 1
        return model

    rows, df = vectors(spark, 300, 24)
    monkeypatch.setattr(multiindex, "learn", narrow)
    got = sorted(map(tuple, nearest(df).collect()))
    want = expected(rows, 20, 20, True, lambda a, b: float(a @ b))
    assert [r[:3] for r in got] == [r[:3] for r in want]


def test_nearest_has_recall_and_exact_scores(spark):
    rows, df = vectors(spark, 900, 24)
    got = sorted(map(tuple, nearest(df).collect()))
    want = expected(rows, 20, 20, True, lambda a, b: float(a @ b))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    hits = len({(r[0], r[2]) for r in got} & {(r[0], r[2]) for r in want})
    assert hits / len(want) >= 0.9
    score = {(i): np.array(v, np.float32).astype(float) for i, v, *_ in rows if v and i is not None and None not in v}
    for q, _, i, s in got:
        assert s == pytest.approx(score[q] @ score[i], rel=1e-12)
    assert all(a[3] > b[3] or (a[3] == b[3] and a[2] < b[2]) for a, b in zip(got, got[1:]) if a[0] == b[0])


def test_lengths_matter_for_inner_products():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 16)) * rng.uniform(0.2, 3, (2000, 1))
    model = learn(x, float(np.linalg.norm(x, axis=1).max()))
    index, asked = MultiIndex(model.of(x, False)), model.of(x, True)
    hits = 0
    for i in range(50):
        s = x @ x[i]
        top = np.argsort(-s)[:20]
        hits += len(set(top) & set(index.within(asked[i], model.radius(asked[i]))))
    assert hits / 1000 >= 0.9


def test_empty(spark):
    _, df = vectors(spark, 10)
    assert exact_top_k(df.limit(0)).count() == 0 and nearest(df.limit(0)).count() == 0
    one = df.where("vec_id = 0").limit(1)
    assert exact_top_k(one).count() == 0 and nearest(one).count() == 0
    random.seed(0)
