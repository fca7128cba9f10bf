"""Licence scans by diagonal voting.

All rolling k-grams of a document's words are joined to the positions where the
templates have the same k-gram. Matches of one copy of a template lie on one
diagonal (document position less template position); an edit moves the rest to a
neighbouring one. So votes are counted by diagonal, diagonals a few words apart
are merged into a span, and a span is verified by the share of the template's
words that its matches cover.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

#: Words in a k-gram; how many words neighbouring diagonals are apart at most; share of a template's words that a span must cover.
GRAM, NEAR, COVER = 3, 3, 0.75
#: Templates of fewer words must be there whole: a few of their words in a row are common phrases.
SHORT = 12
#: Words that all templates together may have: what is sent to every executor is no larger.
TEMPLATE_WORDS = 100_000

#: Everything but digits and small letters of ASCII is a gap; capital letters are made small.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

# Phrases and labels that are always looked for.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Notices as their licences word them, by label.
NOTICES = (
    ("mit", "released under the MIT License"),
    ("mit", "licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2.0", "licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-3.0", "this work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "either version 3 of the License, or (at your option) any later version"),
    ("gpl-2.0", "either version 2 of the License, or (at your option) any later version"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0"),
    ("cc-by-nd-4.0", "licensed under CC BY-ND 4.0"),
    ("cc-by-4.0", "licensed under CC BY 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

_NO_WARRANTY = (
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Whole licences, or the whole notice that a licence asks for, by label.
BODIES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _NO_WARRANTY),
    ("bsd-2-clause", _BSD_HEAD + _BSD_TAIL),
    ("bsd-3-clause", _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_TAIL),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
TEMPLATES = NOTICES + BODIES


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def gram_hashes(words: list[bytes], k: int = GRAM) -> np.ndarray:
    """A 64-bit hash (int64) of each k consecutive words."""
    if len(words) < k:
        return np.empty(0, np.int64)
    w = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    n = len(w) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out ^ w[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _text_key(text: str | None) -> int:
    return xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass")) - (1 << 63)


def phrase_places(words: list[bytes]) -> tuple[int, int | None, int | None, str]:
    """Places of all base phrases: their number, smallest and largest start, and labels, sorted and comma-joined."""
    joined = b" " + b" ".join(words) + b" "
    starts, labels = [], set()
    for phrase, label in PHRASES:
        wanted = f" {phrase} ".encode()
        at, counted, word = joined.find(wanted), 0, 0
        while at >= 0:
            word += joined.count(b" ", counted, at)
            counted = at
            starts.append(word)
            labels.add(label)
            at = joined.find(wanted, at + 1)
    return len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def base_rows(docs: DataFrame) -> DataFrame:
    """id, key of the text, n_words and what phrase_places() has of each row of docs (id, text)."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column("text"):
                text = x.as_py()
                words = words_of(text)
                out.append((_text_key(text), len(words), *phrase_places(words)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 6, kinds))], names=["id", "key", "n_words", "n_base", "first_word", "last_word", "base_labels"])

    return docs.mapInArrow(run, f"id {id_type}, key long, n_words long, n_base long, first_word long, last_word long, base_labels string")


def gram_rows(docs: DataFrame, k: int) -> DataFrame:
    """id, key of the text, position and hash of every k-gram of every row of docs."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, keys, hashes, held = [], [], [], 0
            for i, x in enumerate(b.column("text")):
                text = x.as_py()
                h = gram_hashes(words_of(text), k)
                rows.append(i), keys.append(_text_key(text)), hashes.append(h)
                held += len(h)
                if held > 500_000 or i == b.num_rows - 1:
                    n = np.array([len(h) for h in hashes])
                    position = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(np.repeat(rows, n))), pa.array(np.repeat(np.array(keys, np.int64), n)), pa.array(position.astype(np.int32)), pa.array(np.concatenate(hashes))], names=["id", "key", "pos", "gram"])
                    rows, keys, hashes, held = [], [], [], 0

    return docs.mapInArrow(run, f"id {id_type}, key long, pos int, gram long")


def template_grams(spark: SparkSession, notices: tuple, k: int) -> DataFrame:
    """gram, template, position in it, its words and its label; an error if the templates are too long to send around."""
    rows = []
    for t, (label, text) in enumerate(notices):
        words = words_of(text)
        rows += [(int(h), t, i, len(words), label) for i, h in enumerate(gram_hashes(words, k))]
    if len(rows) > TEMPLATE_WORDS:
        raise ValueError(f"templates of {len(rows)} words; at most {TEMPLATE_WORDS} are broadcast")
    return spark.createDataFrame(rows, "tgram long, template int, tpos int, twords int, label string")


def spans(docs: DataFrame, notices: tuple = TEMPLATES, k: int = GRAM, near: int = NEAR, cover: float = COVER) -> DataFrame:
    """id, key, template, label, first_word, end_word, votes and coverage of every verified span of docs (id, text)."""
    grams = gram_rows(docs, k)
    found = grams.join(F.broadcast(template_grams(docs.sparkSession, notices, k)), F.col("gram") == F.col("tgram"))
    found = found.select("id", "key", "template", "label", "twords", (F.col("pos") - F.col("tpos")).alias("diagonal"), "pos", "tpos")
    # A diagonal has at most as many different template positions as the template has words; repeated rows add none.
    votes = found.groupBy("id", "key", "template", "label", "twords", "diagonal").agg(F.collect_set("tpos").alias("at"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    own = Window.partitionBy("id", "key", "template").orderBy("diagonal")
    apart = F.when(F.col("diagonal") - F.lag("diagonal").over(own) <= near, 0).otherwise(1)
    merged = votes.withColumn("apart", apart).withColumn("span", F.sum("apart").over(own))
    merged = merged.groupBy("id", "key", "template", "label", "twords", "span").agg(
        F.sum(F.size("at")).alias("votes"), F.min("low").alias("first_word"), (F.max("high") + k).alias("end_word"), F.array_distinct(F.flatten(F.collect_set("at"))).alias("at")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x, x + (k - 1))))))
    wanted = F.when(F.col("twords") < SHORT, 1.0).otherwise(cover)
    return merged.withColumn("coverage", covered / F.col("twords")).where(F.col("coverage") >= wanted).drop("at", "span", "twords")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: tuple = TEMPLATES) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row of docs.

    score: the best coverage of a verified span, and 1 where a base phrase
    stands; 0 without either. Templates are sought in whole texts, which are one
    row each, however long; of spans of equal coverage all count. Null texts are empty: no words, no labels, nulls
    for first and last. Rows that repeat id and text get equal results; rows of
    one id with other texts, and null ids, keep their own. An empty table gives
    an empty result. Other columns aren't looked at.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    best = spans(own, notices).groupBy("id", "key").agg(F.collect_set("label").alias("found"), F.max("coverage").alias("coverage")).withColumnsRenamed({"id": "_id", "key": "_key"})
    rows = base_rows(own).join(best, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    base = F.filter(F.split("base_labels", ","), lambda x: x != "")
    labels = F.array_join(F.array_sort(F.array_union(base, F.coalesce("found", F.array().cast("array<string>")))), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("coverage", F.lit(0.0)))
    return rows.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.cast("double").alias("score"))


def op7_licence_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle(notices: tuple = TEMPLATES) -> str:
    """The query's rows in SQL: k-grams as words, not as hashes, and every step as a join or a window."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    values = ", ".join("({}, '{}', '{}')".format(i, label, text.replace("'", "''")) for i, (label, text) in enumerate(notices))
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {words} AS ws FROM documents),
w AS (SELECT rid, unnest(ws) AS a, generate_subscripts(ws, 1) - 1 AS pos FROM d),
g AS MATERIALIZED (SELECT rid, pos, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY rid ORDER BY pos)),
p AS (SELECT rid, pos, 'cc-by' AS label FROM g WHERE a = 'cc' AND b = 'by' UNION ALL SELECT rid, pos, 'gpl' FROM g WHERE a = 'general' AND b = 'public' AND c = 'license' UNION ALL SELECT rid, pos, 'reserved' FROM g WHERE a = 'all' AND b = 'rights' AND c = 'reserved'),
base AS (SELECT rid, count(*) AS n, min(pos) AS low, max(pos) AS high, list(DISTINCT label) AS labels FROM p GROUP BY rid),
t AS (SELECT no, label, {words} AS ws FROM (VALUES {values}) AS v(no, label, text)),
tw AS (SELECT no, label, len(ws) AS twords, unnest(ws) AS a, generate_subscripts(ws, 1) - 1 AS tpos FROM t),
tg AS (SELECT *, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM tw WINDOW o AS (PARTITION BY no ORDER BY tpos)),
v AS (SELECT DISTINCT g.rid, tg.no, tg.label, tg.twords, g.pos - tg.tpos AS diagonal, tg.tpos FROM g JOIN tg USING (a, b, c)),
s AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, no ORDER BY diagonal) <= {NEAR} THEN 0 ELSE 1 END AS apart FROM (SELECT DISTINCT rid, no, diagonal FROM v)),
n AS (SELECT rid, no, diagonal, sum(apart) OVER (PARTITION BY rid, no ORDER BY diagonal) AS span FROM s),
c AS (SELECT DISTINCT v.rid, v.no, v.label, v.twords, n.span, v.tpos + k.i AS word FROM v JOIN n USING (rid, no, diagonal), (VALUES (0), (1), (2)) AS k(i)),
e AS (SELECT rid, label, count(*) / CAST(twords AS DOUBLE) AS coverage FROM c GROUP BY rid, no, label, twords, span HAVING count(*) / CAST(twords AS DOUBLE) >= CASE WHEN twords < {SHORT} THEN 1.0 ELSE {COVER} END),
best AS (SELECT rid, max(coverage) AS coverage, list(DISTINCT label) AS labels FROM e GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base, CAST(low AS BIGINT) AS first_word, CAST(high AS BIGINT) AS last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(best.labels, [])))), ',') AS labels,
  CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(coverage, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN best USING (rid)"""
