import random
import re

import pytest
from clausemill.llm.common import spread_rank
from clausemill.llm.mixing import CAP, fit, mix, mixed_rows
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes: dict, weights=(5, 2, 1), share=1.5, cap=2.0) -> dict:
    """The contract read literally: share out, cap, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while True:
        level = left / sum(w[s] for s in open_) if open_ else 0
        over = {s for s in open_ if w[s] * level > cap * sizes[s]}
        if not over:
            return out | {s: w[s] * level for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, target int, _row string")


def sample(n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "b", "B", "ä", None])
        text = rng.choice([None, "", " \t", " ".join(rng.choice(["x", "yy z", "q r"]) for _ in range(rng.randint(1, 40)))]) if rng.random() < 0.3 else " ".join("w" for _ in range(rng.randint(1, 200)))
        rows.append((i, text, source, "clash", 3, "clash"))
    return rows


def test_fit_reaches_the_budget_or_the_best_below():
    rng = random.Random(0)
    for _ in range(200):
        lengths = rng.sample(range(1, 60), rng.randint(1, 8))
        counts = [rng.randint(1, 4) for _ in lengths]
        budget = rng.randint(0, sum(a * b for a, b in zip(lengths, counts)) + 5)
        take = fit(lengths, counts, budget)
        assert all(0 <= k <= n for k, n in zip(take, counts))
        reach = {0}
        for x, n in zip(lengths, counts):
            reach = {r + k * x for r in reach for k in range(n + 1)}
        assert sum(k * x for k, x in zip(take, lengths)) == max(r for r in reach if r <= budget)


def test_fit_of_long_documents_alone():
    assert fit([3000, 5000, 7000], [1, 1, 1], 8000) == [1, 1, 0]
    assert fit([3000, 5000, 7000], [1, 1, 1], 9500) == [1, 1, 0]  # 8000 is the nearest below
    rng = random.Random(5)
    for _ in range(20):
        lengths = rng.sample(range(3000, 20000), rng.randint(2, 6))
        counts = [rng.randint(1, 3) for _ in lengths]
        budget = rng.randint(0, sum(a * b for a, b in zip(lengths, counts)))
        take = fit(lengths, counts, budget)
        assert all(0 <= k <= n for k, n in zip(take, counts))
        reach = {0}
        for x, n in zip(lengths, counts):
            reach = {r + k * x for r in reach for k in range(n + 1)}
        assert sum(k * x for k, x in zip(take, lengths)) == max(r for r in reach if r <= budget)


def test_targets_sizes_and_limits(spark):
    rows = sample()
    got = mix(documents(spark, rows), ["doc_id"]).collect()
    sizes = {}
    for i, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    want = targets(sizes)
    assert len(got) == len(rows)
    taken = {}
    source_of = {r[0]: r[2] for r in rows}
    for r in got:
        assert r["size"] == len(WORD.findall(rows[r.doc_id][1] or ""))
        assert r.source_size == sizes[source_of[r.doc_id]] and r.target == pytest.approx(want[source_of[r.doc_id]])
        assert 0 <= r.taken <= CAP * r["size"] and r.taken % max(1, r["size"]) == 0
        taken[source_of[r.doc_id]] = taken.get(source_of[r.doc_id], 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2, (s, taken[s], t)
    assert sorted(got) == sorted(mix(documents(spark, rows).repartition(3), ["doc_id"]).collect())


def test_repeats_empty_table_and_rows(spark):
    none = documents(spark, [])
    assert mix(none, ["doc_id"]).collect() == [] and mixed_rows(none).collect() == []
    rows = [(1, "a b", "s", "c", 1, "r")] * 3 + [(None, None, None, None, None, None)] * 2
    got = mix(documents(spark, rows), ["doc_id"]).collect()
    assert len(got) == 5 and sum(r.taken for r in got) == 8  # 150% of six words is nine; whole documents of two words
    out = mixed_rows(documents(spark, rows))
    assert out.columns == ["doc_id", "text", "source", "size", "target", "_row"]
    assert out.where("doc_id = 1 and size = 'c' and target = 1 and _row = 'r'").count() == 4


def test_the_rows_taken_do_not_depend_on_how_the_table_is_dealt(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("ab" for _ in range(rng.randint(1, 9))), f"s{i % 3}", None, None, None) for i in range(600)] + [(1000, "x y", "s1", "c", 1, "r")] * 40
    df = documents(spark, rows)

    def taken(df):
        return sorted(map(tuple, mixed_rows(df).select("doc_id", "text").collect()))

    once = taken(df)
    assert once == taken(df.repartition(3)) == taken(df.repartition(7, "text")) and len(once) > 600


def test_all_sources_at_their_cap(spark):
    rows = [(i, "a b c", "s", None, None, None) for i in range(4)]
    got = mix(documents(spark, rows), ["doc_id"], share=2.0).collect()
    assert all(r.taken == 6 and r.target == 24 for r in got)


def test_spread_rank_is_a_rank(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4000, None).otherwise(F.col("id") % 3).alias("k"), (F.col("id") % 1000).alias("v"))
    got = spread_rank(df, ["k"], [F.col("v")], "rk", buckets=16)
    for r in got.groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("rk").alias("d"), F.max("rk").alias("m"), F.min("rk").alias("lo")).collect():
        assert r.n == r.d == r.m + 1 and r.lo == 0
