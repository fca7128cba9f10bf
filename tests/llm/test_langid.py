import random
import zlib

import numpy as np
from clausemill.llm import langid
from clausemill.llm.langid import BUCKET_BITS, CHUNK, buckets, detect, known_language, least_known, train
from pyspark.sql import functions as F

SYLLABLES = {"xx": "ba be bi bo bu da de".split(), "yy": "kra klo pst ñu ñe ört".split(), "zz": "the ing ation ou ea".split()}


def documents(n=400, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 80))]
        out.append((i, " ".join(words).capitalize() + ".", lang if rng.random() < 0.9 else None, lang))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_held_out_accuracy(spark):
    rows = documents()
    got = {r.doc_id: r for r in detect(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in set(held)) and 0 <= got[i].score <= 1 and got[i].lang_pred in SYLLABLES for i, *_ in rows)
    assert np.mean([got[i].lang_pred == rows[i][3] for i in held]) > 0.97
    assert not any(r.rejected for r in got.values())


def test_labels_of_the_held_out_fold_and_of_the_row_are_not_read(spark):
    rows = documents()
    wrong = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, s) for i, t, lang, s in rows]
    a = sorted((r.doc_id, r.lang_pred, r.score) for r in detect(frame(spark, rows)).collect())
    assert a == sorted((r.doc_id, r.lang_pred, r.score) for r in detect(frame(spark, wrong)).collect())


def test_odd_rows(spark):
    rows = documents(200) + [(1000, None, "xx", "s"), (1001, "", "xx", "s"), (1002, "12 !? …", "xx", "s"), (None, "ba be", None, None), (7, documents(8)[7][1], "yy", "s")]
    got = detect(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    odd = {r.doc_id: r for r in got if r.doc_id and r.doc_id >= 1000}
    assert all(r.lang_pred == "und" and r.score == 0 and r.rejected for r in odd.values())
    kept = known_language(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "score"] and kept.count() == len(rows) - 3


def test_texts_in_no_learned_language_are_rejected(spark):
    strangers = ["Съешь же ещё этих мягких булок", "今日はいい天気ですね", "vqx wjq zxv qqj wvz"]
    rows = documents(600) + [(2000 + i, t, None, "s") for i, t in enumerate(strangers)]
    rejected = {r.doc_id for r in detect(frame(spark, rows)).where("rejected").collect()}
    assert rejected == {2000, 2001, 2002}
    assert known_language(frame(spark, rows)).count() == 600
    assert least_known(0.98, 0.3) > 0.5 and least_known(0.2, 0.3) == 0.0 and least_known(1.0, 0.0) == 0.0


def test_limits_are_calibrated_on_few_rows_and_many_languages(spark, monkeypatch):
    stranger = (2000, "Съешь же ещё этих мягких булок", None, "s")
    rows = documents(60, seed=3)
    assert sum(1 for i, _, lang, _ in rows if lang and zlib.crc32(str(i).encode()) % 3 != 1) < 20 * 3
    got = detect(frame(spark, [*rows, stranger])).where("rejected").collect()
    assert [r.doc_id for r in got] == [2000]
    monkeypatch.setattr(langid, "SAMPLE", 30)  # as if of 2000 rows few were left to a language
    assert {r.doc_id for r in detect(frame(spark, [*documents(600), stranger])).where("rejected").collect()} == {2000}
    one = [(np.array([k]), np.ones(1), str(k)) for k in range(3)]
    assert train(one).least_known == 0.0 and train(one + one).least_known >= 0.0


def test_a_hot_id_does_not_swell_the_sample(spark):
    hot = next(i for i in range(400, 500) if zlib.crc32(str(i).encode()) % 3 != 1)
    rows = documents(300) + [(hot, "ba be bi bo", "xx", "s")] * 300
    fitted = langid.fit_model(frame(spark, rows), "doc_id", "text", "lang")
    once = langid.fit_model(frame(spark, rows[:301]), "doc_id", "text", "lang")
    assert fitted.langs == ["xx", "yy", "zz"] and np.array_equal(fitted.scores, once.scores)
    none = frame(spark, [(None, f"ba be {'bi ' * (i % 50)} {i * 'be '}", "xx", "s") for i in range(6000)])
    assert none.where(F.pmod(F.xxhash64(F.lit(langid.SEED), "doc_id", "text"), F.lit(6000)) < langid.SAMPLE).count() < 1.2 * langid.SAMPLE


def test_nothing_to_learn_from(spark):
    none = frame(spark, [(1, "ba", None, None), (2, None, None, None)])
    assert {(r.lang_pred, r.score) for r in detect(none).collect()} == {("und", 0.0)}
    assert detect(none.limit(0)).count() == 0 and known_language(none.limit(0)).count() == 0


def test_long_texts_are_read_whole():
    def counts(text):
        return sum(np.bincount(b, minlength=1 << BUCKET_BITS) for b in buckets(text))

    text = "abc de " * (CHUNK // 7)
    whole = counts(text + "the end")
    assert (counts(text) <= whole).all() and whole.sum() > counts(text).sum()
    assert train([]).predict("abc") == ("und", 0.0, True)


def test_no_language_is_too_large_for_the_sample():
    for n_langs in (1, 4, 100, 1000):
        for n in (1, 50, 10**7, 10**9, 10**12, 10**15):
            share, each = langid.share_of(n, n_langs), max(langid.SAMPLE / n_langs, langid.EACH)
            assert 1 <= share <= langid.WHOLE and share / langid.WHOLE * n >= min(n, each) * 0.999
