import hashlib

import pytest
from pyspark.sql import functions as F

from tests.compare import assert_same
from tidemark.llm import warc
from tidemark.llm.queries import ORACLES, QUERIES

BIG = "<p>é</p>\r\n\r\nWARC/1.1\r\n" * 80
PAGES = [(1, "http://a.example/", BIG), (2, "http://b.example/\r\nX: y", BIG), (3, None, BIG), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (7, "u", ""), (None, "u", "z" * 2000), (9, "u", "z" * 2000)]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, header string")


def test_archive(spark, pages, tmp_path):
    warc.write_archive(pages, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 4
    archive = warc.read_archive(spark, str(tmp_path / "a"))
    rows = archive.collect()
    assert len(rows) == len(PAGES)
    html = {p[0]: (p[2] or "").encode() for p in PAGES}
    for r in rows:
        assert bytes(r.payload) == html[r.page_id] and r.payload_bytes == len(html[r.page_id])
        assert r.payload_digest == hashlib.sha1(html[r.page_id]).hexdigest()
        assert bytes(r.record) == r.header.encode() + (bytes(r.payload) if r.record_type == "response" else b"")
        assert r.record_sha256 == hashlib.sha256(bytes(r.record)).hexdigest()
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in rows}
    assert kinds == {1: ("revisit", 3), 2: ("revisit", 3), 3: ("response", None), **{i: ("response", None) for i in (4, 5, 6, 7, 9)}, None: ("revisit", 9)}
    warc.write_files(archive, str(tmp_path / "f"))
    back = {r.page_id: r for r in warc.read_files(spark, str(tmp_path / "f")).collect()}
    for r in rows:
        assert (back[r.page_id].record_type, back[r.page_id].refers_to) == (r.record_type, r.refers_to)
        assert bytes(back[r.page_id].payload) == (bytes(r.payload) if r.record_type == "response" else b"")


def test_damage_is_found(spark, pages, tmp_path):
    warc.write_archive(pages, str(tmp_path / "a"))
    bad = spark.read.parquet(str(tmp_path / "a/payloads")).selectExpr("sha256", "cast('other' as binary) AS payload")
    bad.write.parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(str(tmp_path / "a/records")).write.parquet(str(tmp_path / "b/records"))
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(spark, str(tmp_path / "b")).collect()


def test_wrong_length_is_found(spark, pages, tmp_path):
    warc.write_archive(pages, str(tmp_path / "a"))
    records = spark.read.parquet(str(tmp_path / "a/records"))
    records.withColumn("header", F.concat("header", F.lit("X-More: 1"))).write.parquet(str(tmp_path / "b/records"))
    spark.read.parquet(str(tmp_path / "a/payloads")).write.parquet(str(tmp_path / "b/payloads"))
    with pytest.raises(Exception, match="another length"):
        warc.read_archive(spark, str(tmp_path / "b")).collect()


def test_empty(spark, pages, tmp_path):
    warc.write_archive(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_archive(spark, str(tmp_path / "e")).collect() == []


def test_query(spark, tiny):
    assert_same(QUERIES["op4_warc_archive"](spark, tiny), ORACLES["op4_warc_archive"], tiny)
