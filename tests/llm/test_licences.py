import random
import re

import duckdb

from clausemill.llm.licences import BODIES, NOTICES, TEMPLATES, gram_hashes, op7_licence_scan, oracle, scan, spans, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


def plain(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    starts, labels = [], set()
    for phrase, label in PHRASES:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def filler(rng, n):
    return " ".join(rng.choices("lorem ipsum dolor sit amet the under license É ünï".split(), k=n))


def documents():
    rng = random.Random(0)
    rows = [None, "", " .,!", "CC BY", "cc-by cc by", "All Rights  Reserved; all rights reserved all rights", "GNU General Public\nLicense"]
    for label, notice in NOTICES:
        rows.append(filler(rng, 40) + "\n" + notice + " " + filler(rng, 30))
    rows += [filler(rng, 300) for _ in range(20)]
    return rows


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "a", 1) for i, t in enumerate(texts)], "doc_id long, text string, key string, labels int")


def test_words_and_base(spark):
    texts = documents()
    got = {r.doc_id: r for r in scan(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_notices_are_found_and_clean_texts_are_not(spark):
    texts = documents()
    got = {r.doc_id: r for r in scan(frame(spark, texts)).collect()}
    for i, (label, _) in enumerate(NOTICES):
        assert label in got[7 + i].labels.split(",") and got[7 + i].score >= 0.99
    assert all(got[i].labels == "" and got[i].score == 0 for i in range(7 + len(NOTICES), len(texts)))


def test_edited_notices_lie_on_neighbouring_diagonals(spark):
    mit = next(n for label, n in NOTICES if label == "mit" and len(n) > 200)
    words = mit.split()
    edited = " ".join(words[:12] + ["really"] + words[12:30] + words[31:])
    docs = spark.createDataFrame([(1, "x y z " + edited), (2, " ".join(words[:15]))], "id long, text string")
    found = spans(docs).where("label = 'mit'").collect()
    assert [r.id for r in found] == [1] and 0.75 <= found[0].coverage < 1 and found[0].first_word == 3


def test_repeats_nulls_and_empty(spark):
    text = "released under the MIT License"
    rows = [(1, text, "a", 1), (1, text, "a", 1), (1, "other words here", "a", 1), (None, text, "a", 1), (None, None, None, None), (2, (text + " ") * 500, "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, labels int")
    got = sorted(((r.doc_id, r.labels, r.n_words) for r in scan(df).collect()), key=str)
    assert got == sorted([(1, "mit", 5), (1, "mit", 5), (1, "", 3), (None, "mit", 5), (None, "", 0), (2, "mit", 2500)], key=str)
    assert scan(df.limit(0)).count() == 0
    assert len(gram_hashes(words_of("a b"))) == 0 and len(gram_hashes(words_of("a b c d"))) == 2


def test_query_equals_its_sql(spark, tmp_path):
    """Also on texts with edited and repeated notices, and on rows that repeat ids."""
    rng = random.Random(7)
    texts = documents()
    for label, notice in TEMPLATES:
        words = notice.split()
        for _ in range(3):
            cut = [w for w in words if rng.random() > rng.choice((0.0, 0.02, 0.1))]
            texts.append(filler(rng, 20) + " " + " ".join(cut) + " " + filler(rng, 5) + (" " + notice if rng.random() < 0.3 else ""))
    rows = [(i // 2, t) for i, t in enumerate(texts)] + [(None, "all rights reserved"), (0, texts[8]), (0, texts[8])]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in op7_licence_scan(spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(got, key=repr) == sorted(con.sql(oracle()).fetchall(), key=repr)
    assert len({r[6] for r in got}) > 12


def test_whole_licences_and_look_alikes(spark):
    bodies = [f"Copyright 2020 Someone\n{text}\nmore words" for _, text in BODIES]
    others = ["The MIT campus was licensed under the old rules", "released under the MIT umbrella of institutes", "he walked all the way under the GNU and the license plate", "subject to the terms of the public house", "permission is hereby granted to enter", "Licensed under the Apache tribe's law", "the software is provided to all users free of charge", "by CC", "rights reserved for all"]
    got = {r.doc_id: r for r in scan(frame(spark, bodies + others)).collect()}
    for i, (label, _) in enumerate(BODIES):
        assert label in got[i].labels.split(",") and got[i].score >= 0.99
    assert "bsd-3-clause" not in got[1].labels.split(",")
    assert all(got[i].labels == "" for i in range(len(bodies), len(bodies) + len(others)))


def test_very_long_text(spark):
    text = "word other " * 400_000 + NOTICES[0][1] + " tail" * 1000
    row = scan(frame(spark, [text])).first()
    assert row.labels == "mit" and row.n_words == 800_005 + 1000
