import json

import pytest
from clausemill.operators import reports
from pyspark.sql import functions as F


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_headers_for_allowed_origins_only(spark):
    allowed = F.array(F.lit("https://a"), F.lit("https://b"))
    a, b, c = one(spark, *[reports.cors_headers(F.lit(o).cast("string"), allowed) for o in ("https://a", "https://x", None)])
    assert a["access-control-allow-origin"] == "https://a" and a["vary"] == "Origin" and b == {} and c == {}


def test_small_columns(spark):
    n = F.lit(None).cast("int")
    assert one(spark, *[reports.can_be_retried(F.lit(x).cast("string")) for x in ("model_busy", "refused", None)]) == (True, False, False)
    assert one(spark, reports.readings_left(F.lit(5), F.lit(3)), reports.readings_left(F.lit(5), n), reports.readings_left(n, n)) == (3, 5, 0)
    assert one(spark, *[reports.stepped(F.lit(a), d, F.lit(k)) for a, d, k in ((2, 1, 3), (0, -1, 3), (-1, 1, 3), (-1, -1, 3), (0, 1, 0))]) == (0, 2, 0, 2, None)
    assert tuple(one(spark, reports.deadlines(F.lit(16000)))[0]) == (380, 440, 470)
    assert one(spark, reports.cost_ceiling(F.lit(40), F.lit(16000), F.lit(20.0), F.lit(10000), F.lit(4.0)))[0] == pytest.approx(14.4)


def test_params_and_replies(spark):
    params = json.loads(one(spark, reports.call_params(F.lit("read this"), "m", 100, "rules", '{"type": "object"}'))[0])
    assert params["messages"] == [{"role": "user", "content": "read this"}] and params["output_config"]["format"]["schema"] == {"type": "object"} and params["fallbacks"] == "default"
    assert "fallbacks" not in json.loads(one(spark, reports.call_params(F.lit("x"), "m", 1, "s", "{}", fallbacks=False))[0])
    for texts, want in ((['{"a": ', "1}"], '{"a":1}'), (['{"a": ', '{"b":2}'], '{"b":2}'), (["x", "y"], None)):
        assert one(spark, F.to_json(reports.reply_json(F.array(*map(F.lit, texts)))))[0] == want


def test_provenance(spark):
    rows = [(1, 1, "model", "claude-x-5"), (1, 2, "cache", "other"), (1, 3, "model", "claude-x-5"), (2, 1, "cache", None), (3, 1, None, None), (4, 1, "model", "claude-x-5"), (4, 2, None, None)]
    got = {r.doc_id: r.provenance for r in reports.provenance(spark.createDataFrame(rows, "doc_id long, part_no int, source string, model string"), "claude-x-5").collect()}
    assert got[1] == "Read by Claude X 5 (parts 1, 3) and other (part 2), in part from the cache. Another model answered where the first declined."
    assert got[2] == "From the cache, read before by Claude X 5." and got[3] == "Not read." and got[4] == "Read by Claude X 5 (part 1)."


def test_plan(spark):
    parts = spark.createDataFrame([(1, 1, 1000), (1, 2, 234), (2, 1, 5)], "doc_id long, part_no int, chars long")
    got = {r.doc_id: (r.n_parts, r.enough, r.plan) for r in reports.reading_plan(parts, spark.createDataFrame([(1, 1)], "doc_id long, left long")).collect()}
    assert got == {1: (2, False, "1,234 characters in 2 parts; 1 reading left"), 2: (1, False, "5 characters in 1 part; 0 readings left")}


def test_spot_check(spark):
    expected = spark.createDataFrame([(1, "them"), (2, "you"), (3, "neutral"), (4, "you")], "sentence_no int, expected string")
    labels = spark.createDataFrame([(1, "you"), (2, "them"), (3, None), (4, "them")], "clause_id int, favours string")
    assert {r.outcome: r.n for r in reports.spot_check(expected, labels).collect()} == {"same": 1, "none": 2, "different": 1}


def test_complete_corpora(spark, tmp_path):
    clauses = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1)], "slug string, clause_id long")
    placed = spark.createDataFrame([("a", 1, None), ("a", 2, None), ("b", None, "not_found"), ("c", 1, None)], "slug string, clause_id long, reason string")
    report = spark.createDataFrame([("a", 0, 0), ("b", 1, 0), ("c", 0, 1)], "slug string, dropped long, relocated long")
    faults = reports.corpus_faults(report, clauses, placed, "slug")
    assert {r.slug: (r.dropped, r.relocated, r.missing) for r in faults.collect()} == {"b": (1, 0, [1]), "c": (0, 1, None)}
    with pytest.raises(ValueError, match="'slug': 'b'"):
        reports.require_none(faults.where("slug = 'b'"))
    reports.require_none(faults.limit(0))
    payloads = spark.createDataFrame([("a", "text", 2, '{"x":1}'), ("b", "t", 1, "{}")], "slug string, text string, clauses int, payload string")
    index = reports.corpus_index(payloads, spark.createDataFrame([("a", "you"), ("a", "them")], "slug string, favours string"))
    reports.write_corpus(payloads, index, str(tmp_path))
    rows = {r.slug: (r.clauses, r.chars, r.tally.you, r.tally.neutral) for r in spark.read.json(str(tmp_path / "index")).collect()}
    assert rows == {"a": (2, 4, 1, 0), "b": (1, 1, 0, 0)}
    assert (tmp_path / "payloads/slug=a").is_dir()


def test_groups_of_the_checklist(spark):
    rows = [(1, "r1", "T1", "you", 5, "1,2,3", 1), (1, "r2", "T2", "them", 1, "4", 2), (1, "r3", "T3", "them", 2, "5,6", 3)]
    checklist = spark.createDataFrame(rows, "doc_id long, rule_id string, topic string, favours string, n_clauses int, first_ids string, place int")
    got = sorted((r.place, r.favours, r.n_kinds, r.found, r.of_all) for r in reports.checklist_groups(checklist, spark.range(53)).collect())
    assert got == [(1, "them", 2, "T2 ¶ 4; T3 ¶ 5, 6", "3 of 53"), (3, "you", 1, "T1 ¶ 1, 2, 3, …", "3 of 53")]
