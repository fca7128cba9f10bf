import os
import subprocess
import sys

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402
from clausemill.llm.common import stored  # noqa: E402
from clausemill.llm.queries import QUERIES  # noqa: E402
from clausemill.llm.simhash import one_of_each  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and docs.count() > 0
        if name == "near_copies":
            assert docs.select("doc_id").distinct().count() == docs.count()
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(docs.columns)
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", QUERIES)
def test_every_registered_operator_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_names():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)]


def test_the_rest_works_without_the_subpackage(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    copy = tmp_path / "repo"
    subprocess.run(["cp", "-r", repo, str(copy)], check=True)
    subprocess.run(["rm", "-rf", str(copy / "clausemill/llm"), str(copy / "tests/llm"), str(copy / "corpus_pipeline.py")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})


def odd_documents(spark):
    import random

    rng = random.Random(1)
    words = {"xx": "ba be bi bo bu da de".split(), "yy": "kra klo pst ñu ñe ört".split()}
    rows = []
    for i in range(120):
        lang = rng.choice(list(words))
        text = " ".join("".join(rng.choices(words[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(5, 60)))
        rows.append((i, text, lang if i % 5 else None, rng.choice(["s1", "s2", None]), len(text), i, "x", i))
    long = " ".join(rng.choices(words["xx"], k=200_000))
    rows += [rows[3], rows[3], (None, rows[4][1], "xx", "s1", 1, None, None, None), (200, None, None, None, None, None, None, None), (201, "", "yy", "s2", 0, 1, "x", 1), (202, "1 2 3", "xx", "s1", 5, 1, "x", 1), (203, long, "xx", "s1", len(long), 1, "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long, doc string, component_id long")


def test_stages_take_odd_rows_and_clashing_names(spark):
    docs = odd_documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = {tuple(r) for r in docs.collect()}
        docs = stored(stage(spark, docs, None), "t")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "doc", "component_id"]
        after = docs.collect()
        assert after and {tuple(r) for r in after} <= before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, None).collect()
    assert sum(r.piece == 0 for r in packed) == len(after)


def test_stages_take_an_empty_table(spark):
    docs = odd_documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, None).count() == 0


def test_language_stage_drops_what_has_no_letters(spark):
    kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, odd_documents(spark), None).collect()}
    assert not kept & {200, 201, 202} and {*range(120), 203} <= kept


def test_one_of_each_keeps_the_smallest_id_and_one_of_its_repeats(spark):
    rows = [(5, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (9, None), (8, ""), (7, "other words stand here now"), (None, "nobody knows whose this text is")]
    got = sorted((tuple(r) for r in one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(3, "a b c d e f"), (8, ""), (7, "other words stand here now"), (None, "nobody knows whose this text is")], key=str)
