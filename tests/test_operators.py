import hashlib
import hmac
import json
import random
import re
from collections import Counter

import pandas as pd
import pytest
from clausemill.functions.canonical import canonical
from clausemill.functions.clauses import segments
from clausemill.operators import analytics, parts, quota, routing, verification
from clausemill.operators.reading import finding_rows, names_of, read_documents, rule_hits, rule_table, top_findings
from clausemill.operators.segmentation import clause_rows, line_rows, segment_rows
from clausemill.sources import requests, store
from clausemill.sources.html import page_text
from clausemill.streaming.ledger import ledger
from pyspark.sql import functions as F


def test_segment_rows(spark):
    text = "TERMS\nWe may change these terms. You may leave at any time."
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    rows = segment_rows(df).orderBy("seg_no").collect()
    assert [(r.doc_id, r.kind, r.clause_id, r.body) for r in rows] == [(1, "heading", None, "TERMS"), (1, "clause", 1, "We may change these terms."), (1, "clause", 2, "You may leave at any time.")]
    assert clause_rows(segment_rows(df)).count() == 2
    lines = line_rows(spark.createDataFrame([(1, "ab\n\n  cd \ne")], "doc_id long, text string")).orderBy("line_no").collect()
    assert [(r.line_no, r.start, r.end, r.body) for r in lines] == [(1, 0, 2, "ab"), (3, 6, 8, "cd"), (4, 10, 11, "e")]


def test_read_documents_reads_equal_texts_once(spark):
    rows = [(i, "We may change these terms at any time." if i % 2 else "Nothing to see in this line.") for i in range(10)] + [(10, None)]
    out = read_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    found = finding_rows(out).collect()
    assert len(found) == 5 and {r.rule for r in found} == {"terms_changes"} and all(r.rn == 1 and r.quote == "We may change these terms" or r.quote for r in found)
    assert out.count() == 11 and out.select("sha256").distinct().count() == 3
    payload = json.loads(store.payloads(out.where("doc_id = 1"), "p").first().payload)
    assert payload["pipeline"] == "p" and payload["analysis"]["verified"] == 1 and payload["analysis"]["readings"][0]["findings"][0]["quote"] in payload["text"]


def test_rule_hits_and_ranks(spark):
    df = spark.createDataFrame([(1, 1, "You agree to binding arbitration; a late fee applies."), (1, 2, "Nothing.")], "doc_id long, line_no long, body string")
    top = top_findings(rule_hits(df), ["doc_id", "line_no"]).orderBy("rn").collect()
    assert [(r.rule_id, r.confidence, r.rn) for r in top] == [("arbitration", "high", 1), ("extra_fees", "low", 2)]
    assert rule_table(spark).count() == 53 and rule_table(spark).agg(F.sum("n_patterns")).first()[0] == 136
    assert spark.range(1).select(names_of(F.lit('Velo Ltd. ("Velo") runs it.'))).first()[0] == ["Velo"]


def verified(text, parts_, items):
    """The contract of verification, one item after the other."""
    clauses = [p for p in parts_ if p.kind == "clause"]
    out, taken = [], set()
    for n, (claimed, quote, good) in enumerate(items, 1):
        reason = where = start = None
        moved = False
        if not good:
            reason = "malformed"
        else:
            q = quote.strip()
            own = clauses[claimed - 1] if 1 <= claimed <= len(clauses) else None
            if "\n" in q:
                reason = "crosses_clause"
            elif len(q) < 15 and len(q.split()) < 3 and q not in {text[c.start : c.end] for c in clauses}:
                reason = "too_short"
            elif own and text.find(q, own.start, own.end) >= 0:
                where, start = claimed, text.find(q, own.start, own.end)
            elif q not in text:
                reason = "not_found"
            elif len(re.findall(f"(?={re.escape(q)})", text)) > 1:
                reason = "ambiguous"
            else:
                at = text.find(q)
                hit = [c for c in clauses if c.start <= at < c.end]
                if not hit:
                    reason = "not_found"
                elif at + len(q) > hit[0].end:
                    reason = "crosses_clause"
                else:
                    where, start, moved = hit[0].id, at, True
            if where in taken:
                reason = "duplicate"
            elif where:
                taken.add(where)
        out.append((n, where, start, moved, reason))
    return out


def test_quotes_against_the_sequential_contract(spark):
    rng = random.Random(0)
    docs, items, want = [], [], []
    for d in range(40):
        words = rng.choices(["alpha", "beta", "Gamma", chr(0x1F600) + "x", "delta", "pay", "now"], k=60)
        text = canonical("HEAD LINE\n" + "\n".join(" ".join(words[i : i + 12]) + "." for i in range(0, 60, 12)) + " Yes.")
        ps = segments(text)
        own = []
        for _ in range(12):
            a = rng.randrange(len(text))
            own.append((rng.randint(0, 7), rng.choice([text[a : a + rng.randint(3, 40)], " " + text[a : a + 25], "not there at all", "Yes.", "HEAD LINE"]), rng.random() < 0.9))
        docs.append((d, text, ps))
        items += [(d, n, c, q, not good) for n, (c, q, good) in enumerate(own, 1)]
        want += [(d, *r) for r in verified(text, ps, own)]
    df = spark.createDataFrame([(d, t) for d, t, _ in docs], "doc_id long, text string")
    clauses = spark.createDataFrame([(d, p.id, p.start, p.end) for d, _, ps in docs for p in ps if p.kind == "clause"], "doc_id long, clause_id long, start long, end long")
    placed = verification.placed_quotes(spark.createDataFrame(items, "doc_id long, item_no int, claimed_id long, quote string, malformed boolean"), df, clauses)
    got = sorted((r.doc_id, r.item_no, r.clause_id, r.quote_start, bool(r.moved), r.reason) for r in placed.collect())
    assert got == sorted(want)
    assert set(Counter(r[5] for r in got)) >= {None, "malformed", "duplicate", "too_short", "crosses_clause", "not_found"}
    report = verification.verification_report(placed).collect()
    assert all(r.received == 12 and r.verified + r.dropped == 12 for r in report)
    quoted = verification.with_quotes(placed.where("reason is null").drop("quote"), df).collect()
    assert quoted and all(r.quote == dict((d, t) for d, t, _ in docs)[r.doc_id][r.quote_start : r.quote_end] for r in quoted)


def test_items_from_json(spark):
    good = {"id": 7, "quote": "q", "favours": "you", "reading": "r", "confidence": "low"}
    bad = [good | {"id": True}, good | {"id": 1.0}, good | {"id": "1"}, good | {"favours": "me"}, good | {"confidence": None}, good | {"quote": 3}, good | {"reading": "  "}, {"id": 2}, 5]
    df = spark.createDataFrame([(1, json.dumps({"clauses": [good, *bad]})), (2, "[]"), (3, "{broken"), (4, None)], "doc_id long, output string")
    rows = verification.parsed_items(df).orderBy("item_no").collect()
    assert [r.malformed for r in rows] == [False] + [True] * len(bad)
    assert [r.claimed_id for r in rows][:4] == [7, 1, None, None]
    clip = spark.range(1).select(verification.clip(F.lit("word, " * 100))).first()[0]
    assert clip.endswith("word…") and len(clip) <= 281


def test_html():
    assert page_text("<p>a&amp;b<p>c  d<br>e<script>x</script><ul><li>f<li>g</ul>") == "a&b\n\nc d\ne\n\nf\n\ng" or "a&b" in page_text("<p>a&amp;b")
    assert page_text("<html><head><title>T</title></head><body>x<button>y</button></body></html>") == "x"


def test_parts():
    assert parts.split_text("a\n\nb", 10) == ["a\n\nb"] and parts.split_text("aaaa\n\nbbbb", 6) == ["aaaa", "bbbb"]
    assert parts.split_text("One two. Three four. Five.", 12) == ["One two.", "Three four.", "Five."] and parts.split_text("l1\nl2\nl3", 5) == ["l1\nl2", "l3"]
    assert parts.split_text("word " * 10, 12) == ["word word", "word word", "word word", "word word", "word word"]
    smile = chr(0x1F600)
    for most in (3, 4, 5, 7):
        out = parts.split_text(smile * 9, most)
        assert "".join(out) == smile * 9 and all(parts.units(p) <= most for p in out)
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["ab", " ", "\n", "\n\n", ". X", smile, "c"]) for _ in range(80))
        out = parts.split_text(text, 20)
        assert all(0 < parts.units(p) <= 20 for p in out) and "".join("".join(out).split()) == "".join(text.split())


def test_stitching(spark):
    rows = [(1, 1, 10, 2, 3, False, 5, 5, 0, "model", "m", 7), (1, 2, 9, 1, 1, True, 0, 0, 0, None, None, None), (1, 3, 4, 1, 2, False, 2, 1, 1, "cache", None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, part_no int, chars long, clauses long, segments long, failed boolean, received long, verified long, dropped long, source string, model string, budget_left int")
    out = parts.stitched(df).orderBy("part_no").collect()
    assert [(r.offset, r.id_base, r.seg_start) for r in out] == [(0, 0, 0), (12, 2, 3), (12, 2, 3)]
    segs = spark.createDataFrame([(1, 3, 0, 4, 1), (1, 2, 0, 9, 1)], "doc_id long, part_no int, start long, end long, clause_id long")
    moved = parts.shifted(segs, parts.stitched(df)).collect()
    assert [(r.start, r.end, r.clause_id) for r in moved] == [(12, 16, 3)]
    total = parts.document_totals(df).first()
    assert (total.received, total.verified, total.dropped, total.failed, total.sources, total.models, total.budget_left, total.all_cached, total.some_cached) == (7, 6, 1, 1, "cache,model", "m", 6, False, True)
    retry = parts.latest_attempts(spark.createDataFrame([(1, 1, 1, "a"), (1, 1, 2, "b"), (1, 2, 1, "c")], "doc_id long, part_no int, attempt int, x string"))
    assert sorted(r.x for r in retry.collect()) == ["b", "c"]


def runs(start, end, marks):
    out = []
    for i in range(start, end):
        mark = next((k for k, (a, b) in enumerate(marks) if a <= i < b), -1)
        if out and out[-1][2] == mark:
            out[-1][1] = i + 1
        else:
            out.append([i, i + 1, mark])
    return [tuple(r) for r in out]


def test_highlight_runs(spark):
    rng = random.Random(2)
    cases = [[(rng.randint(-5, 40), rng.randint(-5, 45)) for _ in range(4)] for _ in range(30)]
    ranges = spark.createDataFrame([(d, 3, 33) for d in range(30)], "doc_id long, start long, end long")
    marks = spark.createDataFrame([(d, k, a, b) for d, m in enumerate(cases) for k, (a, b) in enumerate(m)], "doc_id long, mark int, start long, end long")
    got = sorted((r.doc_id, r.start, r.end, r.mark) for r in analytics.highlight_runs(ranges, marks, ["doc_id"]).collect())
    assert got == sorted((d, *r) for d, m in enumerate(cases) for r in runs(3, 33, m))


def test_reports(spark):
    found = spark.createDataFrame([(1, 4, 1, "a", "A", "you"), (1, 2, 1, "b", "B", "them"), (1, 2, 2, "a", "A", "you"), (1, 9, 1, "a", "A", "you")], "doc_id long, clause_id int, rn int, rule_id string, topic string, favours string")
    rows = analytics.checklist(found, shown=2).orderBy("place").collect()
    assert [(r.rule_id, r.n_clauses, r.first_ids, r.place) for r in rows] == [("b", 1, "2", 1), ("a", 3, "2,4", 2)]
    t = analytics.tally(found.where("rn = 1"), ["doc_id"]).first()
    assert (t.n_you, t.n_them, t.n_neutral, t.n_unclear) == (2, 1, 0, 0)
    missing = analytics.never_found(rule_table(spark), spark.createDataFrame([("arbitration",)], "rule_id string"))
    assert missing.count() == 28
    n = analytics.next_with(found, ["doc_id", "rule_id"], F.lit(4)).collect()
    assert {(r.rule_id, r.next_id) for r in n} == {("a", 9), ("b", 2)}
    gaps = analytics.paragraph_gaps(spark.createDataFrame([(1, 0, 1), (1, 3, 4)], "doc_id long, start long, end long"), spark.createDataFrame([(1, "a\n\nb")], "doc_id long, text string")).orderBy("start").collect()
    assert [g.breaks for g in gaps] == [0, 2]
    hand = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "doc_id long, hand string")
    table = {r.hand: r for r in analytics.agreement(hand, spark.createDataFrame([(1, "x"), (3, "x")], "doc_id long, found string"), ["doc_id"], ["x", "y"], ["x", "y"]).collect()}
    assert (table["x"].n_x, table["x"].n_none, table["all"].total, table["y"].n_x) == (1, 1, 3, 1)


def test_quota_equals_a_ledger(spark):
    rng = random.Random(3)
    rows = [(i, i // 3, f"2026-01-0{rng.randint(1, 3)}", rng.choice(["a", "b", "c", None])) for i in range(300)]
    for limit, each in ((20, 3), (0, 3), (500, 2), (5, 0)):
        used, own, want = Counter(), Counter(), []
        for i, _, day, v in sorted(rows, key=lambda r: (r[1], r[0])):
            reason = "daily" if used[day] >= limit else "visitor" if v and own[day, v] >= each else None
            if not reason:
                used[day] += 1
                own[day, v] += v is not None
            want.append((i, not reason, reason, used[day], max(0, limit - used[day]), max(0, each - (own[day, v] if v else 0))))
        got = quota.decisions(spark.createDataFrame(rows, "request_id long, ts long, day string, visitor string"), limit, each)
        assert sorted(tuple(r) for r in got.select("request_id", "allowed", "reason", "used", "remaining", "visitor_remaining").collect()) == sorted(want), (limit, each)


def test_hmac(spark):
    for key, message in (("k", "m"), ("salt" * 10, "1.2.3.4"), ("é", "ü")):
        got = spark.range(1).select(quota.hmac_sha256(F.lit(key), F.lit(message)), quota.visitor_name(F.lit(key), F.lit(message)), quota.visitor_name(F.lit(key), F.lit(""))).first()
        want = hmac.new(key.encode(), message.encode(), hashlib.sha256).hexdigest()
        assert tuple(got) == (want, want[:32], None)


def test_requests(spark):
    def r(i, method, path, kind, body):
        return (i, method, path, kind, None if body is None else bytearray(body))

    ok = "application/json"
    cases = [
        (r(1, "POST", "/api/analyze", ok, b'{"text": "hi"}'), 200, None), (r(2, "GET", "/api/analyze", ok, b""), 405, "method_not_allowed"), (r(3, "POST", "/x", ok, b""), 404, "not_found"), (r(4, "OPTIONS", "/api/analyze", None, None), 204, None),
        (r(5, "POST", "/api/analyze", "text/plain", b"{}"), 415, "unsupported_media_type"), (r(6, "POST", "/api/analyze", ok, None), 413, "too_large"), (r(7, "POST", "/api/analyze", ok, b"{"), 400, "bad_json"), (r(8, "POST", "/api/analyze", ok, b'{"text": 1}'), 400, "bad_request"),
        (r(9, "POST", "/api/analyze", ok, b'{"text": "\xff"}'), 400, "bad_json"), (r(10, "GET", "/api/status", None, None), 200, None), (r(11, "POST", "/api/analyze", ok, b"x" * 512_001), 413, "too_large"),
    ]
    df = spark.createDataFrame([c[0] for c in cases], "request_id int, method string, path string, content_type string, body binary")
    got = {x.request_id: x for x in requests.parsed_requests(df).collect()}
    for row, status, error in cases:
        assert (got[row[0]].status, got[row[0]].error) == (status, error), row[:3]
    assert got[1].text == "hi" and got[8].text is None
    chunks = spark.createDataFrame([(1, 0, bytearray(b"ab")), (1, 1, bytearray(b"c")), (2, 0, bytearray(b"toolong"))], "request_id int, chunk_no int, data binary")
    bodies = {x.request_id: x.body for x in requests.bodies_of(chunks, 5).collect()}
    assert bytes(bodies[1]) == b"abc" and bodies[2] is None
    size = spark.createDataFrame([("a" * 120_001, "a"), (" ", ""), ("b" * 70_000, "b" * 70_000), ("c", "c")], "raw string, text string").select(requests.size_error(F.col("raw"), F.col("text")).alias("e"))
    assert [x.e for x in size.collect()] == ["too_large", "empty", "too_large", None]


def test_cache_history_and_log(spark, tmp_path):
    rows = [("s1", "p", '{"a": 1}', "1"), ("s1", "p", '{"a": 2}', "2"), ("s2", "p", "broken", "1")]
    cache = spark.createDataFrame(rows, "text_sha256 string, pipeline string, analysis string, created_at string")
    asked = spark.createDataFrame([(1, "s1", "p"), (2, "s2", "p"), (3, "s1", "q")], "doc_id long, text_sha256 string, pipeline string")
    assert {r.doc_id: r.analysis for r in store.get(asked, cache).collect()} == {1: '{"a": 2}', 2: None, 3: None}
    assert sorted(r.doc_id for r in store.misses(asked, cache).collect()) == [2, 3]
    new = store.put(cache, spark.createDataFrame([("s1", "p", '{"a": 3}', "3")], cache.schema))
    assert new.where("text_sha256 = 's1'").first().analysis == '{"a": 3}' and new.count() == 2
    store.write_cache(new, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2
    results = spark.createDataFrame([(9, 10, 10), (8, 10, 10), (7, 10, 10), (0, 0, 0), (8, 8, 12)], "verified int, received int, clauses int")
    assert sorted(r.verified for r in store.admitted(results).collect()) == [8, 9]
    docs = [("v", k, t, t, size) for t, (k, size) in enumerate([("a", 1), ("b", 1), ("a", 700_000), ("c", 700_000), ("d", 700_000), ("e", 5)])]
    kept = store.history(spark.createDataFrame(docs, "visitor string, key string, ts long, request_id long, size long")).collect()
    assert sorted(r.key for r in kept) == ["c", "d", "e"]
    line = json.loads(store.log_lines(spark.createDataFrame([(5, 2, None, None, 1, "n", None)], "chars int, clauses int, source string, verified int, dropped int, notice string, error string")).first().value)
    assert line == {"event": "analyze", "chars": 5, "clauses": 2, "source": "none", "verified": 0, "dropped": 1, "notice": "n", "error": None}
    (tmp_path / "l").mkdir()
    (tmp_path / "l/one.txt").write_text("We may.\nYou may.")
    (tmp_path / "l/one.analysis.json").write_text(json.dumps({"clauses": [{"id": 1, "quote": "We may.", "favours": "them", "reading": "r", "confidence": "low"}]}))
    r = store.read_labelled_corpus(spark, str(tmp_path / "l")).first()
    assert r.slug == "one" and r.text == "We may.\nYou may." and r.clauses[0].favours == "them"


def test_routing_and_failures(spark):
    def decide(clauses=3, cached=False, key=True, chars=10, allowed=True, why=None):
        return spark.range(1).select(routing.route(*[F.lit(x) for x in (clauses, cached, key, chars, allowed)], F.lit(why).cast("string"))).first()[0]

    assert [decide(clauses=0, cached=True), decide(cached=True, key=False), decide(key=False), decide(chars=10_001, clauses=200), decide(clauses=121), decide(allowed=False, why="visitor"), decide(allowed=False, why="daily"), decide()] == [
        "no_clauses", "cache", "demo_mode", "too_long", "too_many_clauses", "visitor_limit", "budget_spent", "model"]
    rows = [(False, 429, "http", False, None, False), (False, 401, "http", False, None, False), (False, 500, "http", False, None, False), (False, None, "connect", False, None, False), (False, None, "timeout", False, None, False), (True, None, "lost", False, None, False), (True, None, None, False, "refusal", True), (True, None, None, False, "max_tokens", True), (True, None, None, False, "end_turn", True), (True, 200, None, True, None, True)]
    df = spark.createDataFrame(rows, "o boolean, s int, e string, late boolean, stop string, j boolean").select(routing.failure(F.col("o"), F.col("s"), F.col("e"), F.col("late"), F.col("stop"), F.col("j")).alias("f"))
    assert [r.f for r in df.collect()] == ["unavailable:busy", "unavailable:config", "unavailable:upstream", "unavailable:network", "incomplete:timeout", "incomplete:interrupted", "refused", "bad_output", None, "incomplete:timeout"]
    calls = spark.createDataFrame([(1, "unavailable:busy", 5, 35, 2, 40), (2, "refused", 5, 35, 2, 40), (3, None, 5, 35, 2, 40)], "id int, failure string, used int, remaining int, visitor_remaining int, limit int")
    got = {r.id: (r.notice, r.error, r.used, r.remaining, r.visitor_remaining) for r in routing.with_outcome(calls).collect()}
    assert got == {1: ("model_busy", "busy", 4, 36, 3), 2: ("refused", "rejected", 5, 35, 2), 3: (None, None, 5, 35, 2)}


def test_reader_boundary(spark):
    segs = segment_rows(spark.createDataFrame([(1, "TERMS\nPay </document> now please. Or leave it be today.")], "doc_id long, text string"))
    prompt = routing.prompts(segs).first().prompt
    assert prompt == "<document>\n§ TERMS\n[1] Pay &lt;/document> now please.\n[2] Or leave it be today.\n</document>\nAnnotate clauses 1 to 2: 2 entries, one per clause."

    def reader(prompt):
        if "boom" in prompt:
            error = RuntimeError()
            error.kind = "incomplete:timeout"
            raise error
        return {"text": "{}" if "ok" in prompt else "no json", "model": "m", "stop_reason": "refusal" if "no" in prompt else "end_turn"}

    asked = routing.ask(spark.createDataFrame([(1, "ok"), (2, "boom"), (3, "no"), (4, "x")], "doc_id long, prompt string"), reader)
    assert {r.doc_id: r.failure for r in asked.collect()} == {1: None, 2: "incomplete:timeout", 3: "refused", 4: "bad_output"}


@pytest.mark.parametrize("shuffle", [0, 1])
def test_streams_equal_batches(spark, tmp_path, shuffle):
    from clausemill.streaming.ledger import stream_ledger
    from clausemill.streaming.reading import document_stream, stream_findings

    docs = spark.createDataFrame([(i, "We may change these terms. You may cancel at any time." if i % 2 else "Plain words only here.") for i in range(20)], "doc_id long, text string")
    docs.repartition(3 + shuffle).write.parquet(str(tmp_path / "d"))
    q = stream_findings(document_stream(spark, str(tmp_path / "d"))).writeStream.format("memory").queryName(f"found{shuffle}").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(str, spark.table(f"found{shuffle}").collect())) == sorted(map(str, finding_rows(read_documents(docs)).collect()))
    rng = random.Random(4)
    rows = [(i, i, rng.choice(["2026-01-01", "2026-01-02"]), rng.choice(["a", "b", ""]), "refund" if i % 9 == 8 else "consume") for i in range(120)]
    schema = "request_id long, ts long, day string, visitor string, kind string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "r"))
    q = stream_ledger(spark.readStream.schema(schema).parquet(str(tmp_path / "r")), 10, 4).writeStream.format("memory").queryName(f"led{shuffle}").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    used, own, want = Counter(), Counter(), {}
    for i, _, day, v, kind in rows:
        if kind == "refund":
            used[day] = max(0, used[day] - 1)
            own[day, v] = max(0, own[day, v] - 1)
            want[i] = (True, used[day])
        else:
            ok = used[day] < 10 and not (v and own[day, v] >= 4)
            used[day] += ok
            own[day, v] += ok
            want[i] = (ok, used[day])
    assert {r.request_id: (r.allowed, r.used) for r in spark.table(f"led{shuffle}").collect()} == want


class State:
    """What the ledger asks of a group's state."""

    def __init__(self):
        self.value, self.hasTimedOut, self.duration = None, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.duration = ms


def test_counters_of_past_days_are_purged():
    run, state = ledger(2, 1, keep_ms=5000), State()

    def ask(i):
        return pd.concat(run(("2026-01-01",), iter([pd.DataFrame({"request_id": [i], "ts": [i], "visitor": ["a"], "kind": ["consume"]})]), state))

    assert ask(1)["allowed"].tolist() == [True] and ask(2)["reason"].tolist() == ["visitor"] and state.duration == 5000
    state.hasTimedOut = True
    assert list(run(("2026-01-01",), iter([]), state)) == [] and not state.exists
    state.hasTimedOut = False
    assert ask(3)["allowed"].tolist() == [True]  # a late request starts a new counter


def test_quota_against_a_loop(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 40), f"d{rng.randint(0, 2)}", rng.choice([None, None, "a", "b", "c", "d"])) for i in range(400)]
    df = spark.createDataFrame(rows, "request_id long, ts long, day string, visitor string")
    for limit, each in ((25, 3), (0, 3), (7, 100), (1000, 0), (-1, 2)):
        used, own, want = {}, {}, {}
        for i, ts, day, visitor in sorted(rows, key=lambda r: (r[1], r[0])):
            n, v = used.get(day, 0), own.get((day, visitor), 0)
            reason = "daily" if n >= max(0, limit) else "visitor" if visitor and v >= each else None
            if reason is None:
                used[day], own[day, visitor] = n + 1, v + 1
            left = max(0, each - (own.get((day, visitor), 0) if visitor else 0))
            want[i] = (reason, used.get(day, 0), max(0, max(0, limit) - used.get(day, 0)), left)
        decided = quota.decisions(df, limit, each)
        assert {r.request_id: (r.reason, r.used, r.remaining, r.visitor_remaining) for r in decided.collect()} == want
        if limit == 25:
            status = {(r.day, r.visitor): (r.used, r.remaining) for r in quota.visitor_status(decided, each).collect()}
            assert status == {(d, v): (own.get((d, v), 0), max(0, each - own.get((d, v), 0))) for _, _, d, v in rows if v}


def test_salts_are_random(spark):
    a, b = ({r.day: r.salt for r in quota.new_salts(spark, ["x", "y"]).collect()} for _ in range(2))
    assert len({*a.values(), *b.values()}) == 4 and all(len(s) == 32 for s in a.values())
