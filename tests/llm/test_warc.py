import base64
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import warc


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "http://b/\r\nEvil: 1", ""), (5, "u", "é漢🙂\r\n\r\nWARC/1.1\r\n"), (0, "z", "<p>x</p>"), (6, "long", "abc " * 200_000)]
    rows += [(0, "z", "<p>x</p>"), (None, "n", "<p>x</p>"), (None, "m", "only here"), (7, "http://ä/ö", "é漢🙂\r\n\r\nWARC/1.1\r\n")]
    rows += [(100 + k, f"http://hot/{k}", "hot page") for k in range(200)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("own")).withColumn("sha", F.lit(1)).withColumn("a.b", F.lit(2)).repartition(4)


def want(rows, least_bytes=0):
    first = {}
    for i, _, t in rows:
        p = (t or "").encode()
        if i is not None and len(p) >= least_bytes:
            first[p] = min(first.get(p, i), i)
    out = Counter()
    for i, _, t in rows:
        p = (t or "").encode()
        again = len(p) >= least_bytes and first.get(p) != i
        out[i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", first[p] if again else None] += 1
    return out


@pytest.mark.parametrize("least", [0, 8])
def test_round_trip(spark, pages, least):
    archives = warc.write_archives(pages, warc.archive_folder(spark), min_dedup_bytes=least)
    index = warc.index(spark, archives)
    assert index.count() == pages.count() == archives.agg(F.sum("records")).first()[0]
    rows = warc.resolved(warc.read(index)).collect()
    number = lambda x: None if x is None else int(x)
    got = Counter((number(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], number(r["refers_to"])) for r in rows)
    assert got == want([(r["page_id"], r["url"], r["html"]) for r in pages.collect()], least)


def test_selected_records(spark, pages):
    index = warc.index(spark, warc.write_archives(pages, warc.archive_folder(spark)))
    some = warc.read(index.where("page_id in ('5', '6') and record_type = 'response'")).collect()
    assert {(r["page_id"], bytes(r["payload"]).decode()) for r in some} == {("5", "é漢🙂\r\n\r\nWARC/1.1\r\n"), ("6", "abc " * 200_000)}
    assert all(r["read_digest"] == r["digest"] for r in some)
    assert {r["url"] for r in index.where("page_id = '4'").collect()} == {"http://b/%0D%0AEvil:%201"}
    assert index.groupBy("archive").agg(F.max(F.col("offset") + F.col("length"))).count() == index.select("archive").distinct().count()


def test_many_archives(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    archives = warc.write_archives(pages, warc.archive_folder(spark))
    assert warc.index(spark, archives).count() == pages.count()


def test_empty(spark, pages):
    archives = warc.write_archives(pages.limit(0), warc.archive_folder(spark))
    assert warc.resolved(warc.read(warc.index(spark, archives))).collect() == []
