import json
import zipfile

from pyspark.sql import functions as F

from tidemark.sources import avro, readers, sinks
from tidemark.streaming import loader


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('a "q", b', "x"), ("line\nend", None)], "t string, u string")
    sinks.write_csv(df, str(tmp_path / "c"), gzip=True)
    back = spark.read.csv(str(tmp_path / "c"), header=True, escape='"', multiLine=True)
    assert sorted(r.t for r in back.collect()) == ['a "q", b', "line\nend"]


def test_required_fields(spark, tmp_path):
    (tmp_path / "l.csv").write_text("A,B,C\n,B,C\nA, ,C\nx,y,\n")
    assert readers.csv_rows(spark, str(tmp_path / "l.csv"), "a string, b string, c string", 2).count() == 2


def test_header_and_last(spark, tmp_path):
    (tmp_path / "h.csv").write_text("﻿filename,v\na,1\na,2\nb,3\n", encoding="utf-8")
    df = readers.csv_with_header(spark, str(tmp_path / "h.csv"))
    assert df.columns == ["filename", "v"]
    assert sorted(map(tuple, readers.last_per_file_name(df, "v").collect())) == [("a", "2"), ("b", "3")]


def test_malformed_rows(spark, tmp_path):
    (tmp_path / "m.csv").write_text("a,b\n1,2\n3\n4,5,6\n")
    assert [tuple(r) for r in readers.csv_with_header(spark, str(tmp_path / "m.csv")).collect()] == [("1", "2")]
    assert sorted(r.line for r in readers.malformed_rows(spark, str(tmp_path / "m.csv")).collect()) == ["3", "4,5,6"]


def test_zip_and_blobs(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.avro", b"one")
        z.writestr("b.txt", b"two")
    rows = readers.zip_members(spark, str(tmp_path / "z.zip")).collect()
    assert [(r.member, bytes(r.content)) for r in rows] == [("a.avro", b"one")]
    blob = readers.blobs(spark, str(tmp_path), 0, 2).first()
    assert bytes(blob.content) == b"PK"
    assert readers.listing(spark, str(tmp_path)).agg(F.sum("length")).first()[0] == (tmp_path / "z.zip").stat().st_size


def test_formats(spark, tmp_path):
    df = spark.sql("SELECT 1 AS id, timestamp'2024-02-03 04:05:06' AS t, date'2024-02-03' AS d, cast(null AS decimal(5,2)) AS n, array('a', 'b') AS l")
    assert tuple(sinks.avro_ready(df).first()) == (1, "03-Feb-2024 04:05:06", "03-Feb-2024", None, "a,b")
    sinks.write_avro(df, str(tmp_path / "p"))
    assert avro.read(spark, str(tmp_path / "p")).count() == 1
    assert json.loads(sinks.as_json(df).first().json)["l"] == ["a", "b"]
    assert "<id>1</id>" in sinks.as_xml(df).first().xml
    assert [r.line for r in sinks.shell_lines(df, [F.lit("x"), F.concat(F.lit("y"), F.col("id"))], "id").collect()] == ["x", "y1"]


def test_download(spark, tmp_path):
    sinks.download(spark.createDataFrame([("u", None, 1)], "imageURL string, b string, a long"), str(tmp_path / "d"))
    assert spark.read.csv(str(tmp_path / "d"), header=True).columns == ["imageURL", "a", "b"]


def test_download_zip(spark, tmp_path):
    df = spark.createDataFrame([("u", None, 1), ('v"w', "x,y", 2)], "imageURL string, b string, a long")
    sinks.download_zip(df, str(tmp_path / "d.zip"))
    with zipfile.ZipFile(tmp_path / "d.zip") as z:
        assert z.namelist() == ["images.csv"]
        lines = z.read("images.csv").decode().splitlines()
    assert lines[0] == '"imageURL","a","b"' and sorted(lines[1:]) == ['"u","1",""', '"v""w","2","x,y"']


def test_records_and_lists(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"id": "1", "multimediaItems": [{"identifier": "u", "title": "t"}]}))
    rows = readers.batch_records(spark, str(tmp_path / "r.json"), "json")
    assert rows.select(F.inline("multimediaItems")).select("identifier", "title", "rights").first() == ("u", "t", None)
    (tmp_path / "tags.csv").write_text("/a/b, c\n\n /d \n")
    assert [r.path for r in readers.tag_paths(spark, str(tmp_path / "tags.csv")).collect()] == ["/a/b, c", "/d"]
    assert [r.term for r in readers.rows_of(spark, ["title", "creator"], "term string").where(F.lower("term").contains("eat")).collect()] == ["creator"]
    have = spark.range(3)
    assert [r.id for r in readers.query(spark, "SELECT id FROM {have} WHERE id > :least", {"least": 1}, have=have).collect()] == [2]
    assert readers.size_on_disk(spark, str(tmp_path)).first().bytes == sum(f.stat().st_size for f in tmp_path.iterdir())


def test_index_and_audit(spark, tmp_path):
    sinks.write_index(spark.range(3), str(tmp_path / "i"))
    sinks.write_index(spark.range(2), str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i")).count() == 2
    for _ in range(2):
        sinks.append_audit(spark.createDataFrame([("m",)], "message string"), str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 2
    assert sinks.as_jsonp(spark.range(1), "f").first().json == 'f({"id":0})'


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, urls in enumerate((["u1", "u2", "u1"], ["u1"])):
        record = {"id": str(k), "multimediaItems": [{"identifier": u} for u in urls]}
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps(record))
    got = []
    for _ in range(2):  # a second start finds nothing to do
        q = loader.load(loader.incoming(spark, str(tmp_path / "in")), str(tmp_path / "ledger"), str(tmp_path / "cp"), lambda df, n: got.append(df.count()))
        q.awaitTermination(120)
    assert sorted(got) == [1, 2]
    assert spark.read.parquet(str(tmp_path / "ledger")).agg(F.sum("items")).first()[0] == 3


def test_jdbc(spark, tmp_path):
    """A table of the database that comes with Spark, read in four parts and in blocks of ten rows."""
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    url, driver = "jdbc:derby:memory:readers;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    spark.range(100).selectExpr("id", "concat('t', id) AS title").write.jdbc(url, "image", properties={"driver": driver})
    rows = readers.jdbc(spark, url, "image", fetch=10, driver=driver, partitionColumn="ID", lowerBound="0", upperBound="100", numPartitions="4")
    assert rows.rdd.getNumPartitions() == 4 and sorted(tuple(r) for r in rows.collect()) == [(i, f"t{i}") for i in range(100)]
    some = readers.jdbc(spark, url, '(SELECT * FROM image WHERE "id" > 90) t', driver=driver)
    assert some.count() == 9
