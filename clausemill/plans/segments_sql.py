"""Exact segments in SQL: the twin of functions.clauses, with lists and windows instead of a scan.

It leaves out the cut of pieces of more than 900 characters at semicolons.
"""

from __future__ import annotations

from .planted import lines_sql

# Fixed values, as in functions.clauses but written for SQL.
ABBREVIATIONS = (
    "e.g i.e etc inc ltd llc llp plc co corp no nos sec secs art arts para paras cl sch pp p vs v cf approx dept est fig figs mr mrs ms dr st jr sr u.s u.k e.u a.m p.m "
    "jan feb mar apr jun jul aug sep sept oct nov dec pty ref"
)
SMALL = "a an and as at by for from in into of on or the to with your our its"
NUMBERING = r"(?i)^(?:#+\s*)?(?:(?:section|article|part|clause|schedule)\s+)?(?:\d+(?:\.\d+)*|[IVXLC]+|[A-Z])[.)]?\s+"
SENTENCE = r"""([.!?]["''”’)\]]*)(\s+["''“‘(\[]?[A-Z0-9À-Þ])"""
ITEM = r";(\s+(?:(?:and|or)\s+)?\((?:[a-z]|[ivx]{1,4}|\d{1,2})\)\s)"
LIST_NUMBER = r"(?i)\(?(?:\d+(?:\.\d+)*|[ivxlc]+|[a-z])[.)]?"


def _list(words: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words.split()) + "]"


def _bare(text: str, edge: str) -> str:
    """The words of a text without a number before it and without marks at their ends."""
    marks = f"""'{edge}' || chr(39)"""
    return f"list_filter(list_transform(regexp_split_to_array(regexp_replace({text}, '{NUMBERING}', ''), '\\s+'), lambda w: trim(w, {marks})), lambda w: w <> '')"


def _titled(words: str) -> str:
    plain = f"length(w) >= 4 AND NOT list_contains({_list(SMALL)}, lower(w)) AND NOT regexp_matches(w, '^\\p{{Lu}}')"
    return f"regexp_matches({words}[1], '^\\p{{Lu}}') AND len(list_filter({words}[2:], lambda w: {plain})) = 0"


def segments_sql(relation: str) -> str:
    """doc_id, seg_no, kind, start, end, clause_id and body of the segments of canonical texts (doc_id, text)."""
    edge = '()[]"“”,&-'
    return f"""
WITH lines AS MATERIALIZED (SELECT *, {_bare('body', edge)} AS ws, length(regexp_replace(body, '[^\\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(body, '[^\\p{{Lu}}]', '', 'g')) AS upper FROM ({lines_sql(relation)})),
kinds AS MATERIALIZED (SELECT doc_id, line_no, start, "end", body, CASE WHEN starts_with(body, '#') THEN length(body) <= 100 WHEN length(body) > 100 OR regexp_matches(body, '[.;,!?]$') OR letters = 0 THEN false
  WHEN letters >= 3 AND upper / letters >= 0.9 AND len(regexp_split_to_array(body, '\\s+')) <= 12 THEN true ELSE len(ws) BETWEEN 1 AND 9 AND right(body, 1) <> ':' AND {_titled('ws')} END AS heading FROM lines),
split AS (SELECT doc_id, line_no, start, string_split(regexp_replace(regexp_replace(body, '{SENTENCE}', '\\1' || chr(30) || '\\2', 'g'), '{ITEM}', ';' || chr(30) || '\\1', 'g'), chr(30)) AS raws FROM kinds WHERE NOT heading),
raws AS (SELECT doc_id, line_no, start, unnest(raws) AS raw, generate_subscripts(raws, 1) AS k FROM split),
ends AS (SELECT *, regexp_replace(raw, '["”’)\\]'']*$', '') AS q FROM raws),
tokens AS (SELECT *, regexp_extract(q, '(\\S+)$', 1) AS token FROM ends),
cuts AS (SELECT *, NOT (right(q, 1) = '.' AND (list_contains({_list(ABBREVIATIONS)}, lower(rtrim(ltrim(token, '("“‘[' || chr(39)), '.'))) OR regexp_full_match(lower(rtrim(ltrim(token, '("“‘[' || chr(39)), '.')), '[a-z](?:\\.[a-z])*')
  OR k = 1 AND token = q AND regexp_full_match(token, '{LIST_NUMBER}'))) AS cut, coalesce(sum(length(raw)) OVER (PARTITION BY doc_id, line_no ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM tokens),
numbered AS (SELECT *, coalesce(sum(CAST(cut AS INTEGER)) OVER (PARTITION BY doc_id, line_no ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS i FROM cuts),
pieces AS (SELECT doc_id, line_no, i, min(start + before + length(raw) - length(ltrim(raw))) AS a, max(start + before + length(raw)) AS b, trim(string_agg(raw, '' ORDER BY k)) AS body FROM numbered GROUP BY doc_id, line_no, i),
words AS (SELECT *, {_bare('body', edge + '.')} AS ws, lead(i) OVER (PARTITION BY doc_id, line_no ORDER BY i) IS NULL AS last FROM pieces),
titles AS (SELECT *, last OR NOT (right(body, 1) = '.' AND len(ws) BETWEEN 1 AND 3 AND {_titled('ws')}) AS ending FROM words),
carried AS (SELECT *, coalesce(sum(CAST(ending AS INTEGER)) OVER (PARTITION BY doc_id, line_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM titles),
joined AS (SELECT doc_id, line_no, g, CAST(min(a) AS BIGINT) AS a, CAST(max(b) AS BIGINT) AS b FROM carried GROUP BY doc_id, line_no, g),
folded AS (SELECT doc_id, line_no, max(b) AS final, list_reduce(list_concat([{{'outs': CAST([] AS STRUCT(a BIGINT, b BIGINT)[]), 'begun': CAST(NULL AS BIGINT)}}], list({{'outs': [{{'a': a, 'b': b}}], 'begun': CAST(NULL AS BIGINT)}} ORDER BY g)),
  lambda x, y: CASE WHEN y.outs[1].b - coalesce(x.begun, y.outs[1].a) >= 12 THEN {{'outs': list_append(x.outs, {{'a': coalesce(x.begun, y.outs[1].a), 'b': y.outs[1].b}}), 'begun': CAST(NULL AS BIGINT)}} ELSE {{'outs': x.outs, 'begun': coalesce(x.begun, y.outs[1].a)}} END) AS s FROM joined GROUP BY doc_id, line_no),
closed AS (SELECT doc_id, unnest(CASE WHEN s.begun IS NULL THEN s.outs WHEN len(s.outs) = 0 THEN [{{'a': s.begun, 'b': final}}] ELSE list_append(s.outs[:-2], {{'a': s.outs[-1].a, 'b': final}}) END) AS c FROM folded),
found AS (SELECT doc_id, 'clause' AS kind, c.a AS start, c.b AS "end" FROM closed UNION ALL SELECT doc_id, 'heading', start, "end" FROM kinds WHERE heading)
SELECT f.doc_id, CAST(row_number() OVER (PARTITION BY f.doc_id ORDER BY f.start) - 1 AS INTEGER) AS seg_no, kind, CAST(f.start AS INTEGER) AS start, CAST(f."end" AS INTEGER) AS "end",
  CASE WHEN kind = 'clause' THEN CAST(row_number() OVER (PARTITION BY f.doc_id, kind ORDER BY f.start) AS INTEGER) END AS clause_id, substring(t.text, CAST(f.start + 1 AS BIGINT), CAST(f."end" - f.start AS BIGINT)) AS body
FROM found f JOIN ({relation}) t USING (doc_id)"""
