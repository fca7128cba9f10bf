from clausemill.functions.canonical import canonical
from clausemill.functions.rule_values import RULES
from clausemill.operators.reading import finding_rows, library_of, read_documents
from clausemill.operators.registered import register
from clausemill.sources import requests


def test_functions_in_sql(spark):
    register(spark)
    text = "RIGHTS\r\nYou may  leave\u200b. We may stay."
    row = spark.sql("SELECT canonical_text(t) AS t, clause_segments(canonical_text(t)) AS s, page_text('<p>a<p>b') AS p FROM VALUES (:t) AS v(t)", {"t": text}).first()
    assert row.t == canonical(text) and [s.kind for s in row.s] == ["heading", "clause", "clause"] and row.p.split() == ["a", "b"]


def test_a_stated_length_is_enough_to_refuse(spark):
    rows = [(1, "POST", "/api/analyze", "application/json", bytearray(b'{"text": "a"}'), n) for n in (13, 512_001, None)]
    got = requests.parsed_requests(spark.createDataFrame(rows, "request_id long, method string, path string, content_type string, body binary, content_length long")).collect()
    assert [(r.status, r.error, r.text) for r in got] == [(200, None, "a"), (413, "too_large", None), (200, None, "a")]


def test_rules_from_a_table(spark):
    rules = [(0, "pets", "Pets", "them", "medium", 50, True, False, r"\bstrictly\b", None, [(r"\bno (?:dogs|cats)\b~20~\ballowed\b", None), (r"\bpets\b", "low")])]
    shape = "rule_no int, rule_id string, topic string, favours string, confidence string, weight int, negatable boolean, not_you boolean, strong string, unless string, patterns array<struct<pattern: string, confidence: string>>"
    library = library_of(spark.createDataFrame(rules, shape))
    docs = spark.createDataFrame([(1, "Strictly no dogs are ever allowed in here. Please tell us about your pets today. We may change these terms at any time.")], "doc_id long, text string")
    own = finding_rows(read_documents(docs, library=library)).orderBy("clause_id").collect()
    assert [(r.clause_id, r.rule, r.confidence) for r in own] == [(1, "pets", "high"), (2, "pets", "low")]
    both = finding_rows(read_documents(docs, library=RULES + library)).orderBy("clause_id").collect()
    assert [r.rule for r in both] == ["pets", "pets", "terms_changes"]
