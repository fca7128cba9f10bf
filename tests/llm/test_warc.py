import gzip
import hashlib
import random

import pytest
from clausemill.llm.common import stored
from clausemill.llm.warc import read_archive, read_files, to_archive, write_files
from pyspark.sql import functions as F


def pages(spark):
    rng = random.Random(0)
    big = "é" * 700
    rows = [(i, f"http://x/{i}", rng.choice([big, "short", None, "", "<p>" + "x" * rng.randint(900, 5000), "\r\n\r\n" * 300])) for i in range(80)]
    rows += [(90, None, big), (90, "http://again", big), (None, "http://none", big), (3, "a\r\nb: c", "z" * 1000), (2, None, "z" * 1000), (91, "u", "z" * 999), (92, "u", "z" * 999)]
    return rows, spark.createDataFrame([(*r, "n", 1) for r in rows], "page_id long, url string, html string, sha1 string, record int")


def expected(rows):
    best = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and i is not None:
            best[data] = max(best.get(data, -1), i)
    out = []
    for i, url, html in rows:
        data = (html or "").encode()
        same = sum((h or "") == (html or "") for _, _, h in rows)
        revisit = len(data) >= 1000 and same > 1 and i != best.get(data)
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", best[data] if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [64 << 10, 100])
def test_round_trip(spark, size):
    rows, df = pages(spark)
    archive = stored(to_archive(df, size=size), "t")
    got = read_archive(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)
    assert archive.select(F.max(F.octet_length("data"))).first()[0] < size + 1000
    if size == 100:
        assert archive.where("chunk > 5").count() > 0
        with pytest.raises(Exception, match="damaged|doesn't follow|end mark|bytes with digest"):
            read_archive(archive.where("chunk <> 3")).count()


def test_lost_chunks_and_records_are_errors(spark):
    df = spark.createDataFrame([(1, "u", "a" * 350), (2, "v", "b" * 350), (3, "w", "c")], "page_id long, url string, html string")
    archive = stored(to_archive(df, size=100), "t")
    assert read_archive(archive, 3).count() == 3
    for lost in ("chunk < 3 OR record <> (SELECT min(record) FROM lost_of)", "chunk < 3", "chunk = 0"):
        archive.createOrReplaceTempView("lost_of")
        with pytest.raises(Exception, match="missing"):
            read_archive(archive.where(lost).coalesce(1)).count()
    with pytest.raises(ValueError, match="2 records"):
        read_archive(archive.where("NOT (last AND chunk = 0)"), 3)


@pytest.mark.parametrize("pack", [False, True])
def test_cut_files_are_errors_and_end(spark, tmp_path, pack):
    df = spark.createDataFrame([(1, "u", "a" * 5000)], "page_id long, url string, html string")
    data = b"".join(bytes(r.data) for r in to_archive(df, size=1000).orderBy("chunk").collect())
    path = tmp_path / ("x.warc.gz" if pack else "x.warc")
    for end in (5, 100, 350, 480, 3000, len(data) - 4, len(data) - 1):
        path.write_bytes(gzip.compress(data[:end]) if pack else data[:end])
        with pytest.raises(Exception, match="ends within|no end mark|no length"):
            read_files(spark, [str(path)]).limit(100).count()
    path.write_bytes(data + data)
    if not pack:
        assert read_archive(read_files(spark, [str(path)])).count() == 2


def test_urls_come_back_as_they_were(spark):
    df = spark.createDataFrame([(1, "  http://x/ ", "a"), (2, "", "b"), (3, " ", "c")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.url) for r in read_archive(to_archive(df)).collect()) == [(1, "  http://x/ "), (2, ""), (3, " ")]


def test_archive_is_a_valid_file(spark, tmp_path):
    rows, df = pages(spark)
    archive = stored(to_archive(df, size=500), "t")
    write_files(archive, str(tmp_path), 3)
    files = sorted(map(str, tmp_path.glob("*.warc.gz")))
    assert len(files) == 3
    data = b"".join(gzip.open(f).read() for f in files)
    assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n") and data.count(b"WARC-Type: ") == len(rows)
    again = read_archive(read_files(spark, files, size=300)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, again.collect()), key=str) == expected(rows)


def test_long_and_odd_urls(spark):
    rows = [(1, "http://x/" + "u" * 200_000, "a" * 2000), (2, "http://x/é 語", "a" * 2000), (3, "", "a" * 70_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = read_archive(stored(to_archive(df), "t")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_empty(spark):
    _, df = pages(spark)
    assert read_archive(to_archive(df.limit(0))).count() == 0
