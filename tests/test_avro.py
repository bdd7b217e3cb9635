"""Containers written and read back, in ranges, by other schemas, and damaged."""

import datetime
import decimal
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F, types as T

from tidemark.operators import ingest
from tidemark.sources import avro, readers, sinks

ALL = "id long, b boolean, i int, f float, d double, s string, x binary, day date, at timestamp, price decimal(12,3), list array<string>, m map<string,long>, r struct<a:string,k:array<struct<n:int>>>"


def rows(n):
    for k in range(n):
        yield (
            k - 5, k % 2 == 0, -k, k / 4, -k / 3, f"text é {k}\n" * (k % 4), bytes([k % 256, 0, 255]), datetime.date(1960, 1, 1) + datetime.timedelta(days=37 * k), datetime.datetime(1950, 1, 2, 3, 4, 5, 678901, datetime.timezone.utc) + datetime.timedelta(hours=k * k),
            decimal.Decimal(k * 7001 - 50_000).scaleb(-3), [None, "é", "x" * k][: k % 4], {"a": k, "b": None}, ("in", [(k,), None]) if k % 3 else None,
        )
    yield (None,) * 13


def plain(df):
    return sorted((repr(r) for r in df.collect()), key=str)


def parts(path):
    return sorted(Path(path).glob("*.avro"))


@pytest.mark.parametrize("codec", ["null", "deflate", "bzip2", "xz", "zstandard"])
def test_round_trip(spark, tmp_path, codec):
    df = spark.createDataFrame(list(rows(400)), ALL).repartition(3)
    avro.write(df, str(tmp_path / "t"), codec=codec, blockBytes="2000")
    back = avro.read(spark, str(tmp_path / "t"), splitBytes="2000")
    assert [f.dataType for f in back.schema] == [f.dataType for f in df.schema]
    assert back.rdd.getNumPartitions() > len(parts(tmp_path / "t")) == 3
    assert plain(back) == plain(df)


@pytest.mark.parametrize("split", [1, 17, 100, 1000, 1 << 20])
def test_every_row_is_read_once(spark, tmp_path, split):
    """Whatever the ranges, a block belongs to one of them."""
    avro.write(spark.range(500).coalesce(1).selectExpr("id", "repeat('x', cast(id % 7 as int)) s"), str(tmp_path / "t"), blockBytes="150", codec="null")
    (one,) = parts(tmp_path / "t")
    found = []
    with one.open("rb") as f:
        for a in range(0, one.stat().st_size, split):
            for _, got in avro.read_blocks(f, "f", a, min(a + split, one.stat().st_size), T.StructType([T.StructField("id", T.LongType())])):
                found += [r["id"] for r in got]
    assert found == list(range(500))


def test_other_schemas(spark, tmp_path):
    """Fields go by name without regard to case; absent ones are null, numbers widen, unread ones are passed over."""
    path = str(tmp_path / "t")
    avro.write(spark.createDataFrame([(1, 2.5, "x", [1, 2]), (2, None, None, None)], "Id int, F float, extra string, L array<int>"), path)
    want = T.StructType([T.StructField("id", T.LongType()), T.StructField("rights", T.StringType()), T.StructField("f", T.DoubleType()), T.StructField("l", T.ArrayType(T.LongType()))])
    assert [tuple(r) for r in avro.read(spark, path, want).collect()] == [(1, None, 2.5, [1, 2]), (2, None, None, None)]
    with pytest.raises(Exception, match="can't be read as"):
        avro.read(spark, path, T.StructType([T.StructField("extra", T.IntegerType())])).collect()


def _zig(n):
    out = bytearray()
    avro._put_long(out, n)
    return bytes(out)


def test_foreign_writer(spark, tmp_path):
    """What other writers do: unions of several types, enums, fixed, sized array blocks, names that refer back, an empty union first."""
    schema = {"type": "record", "name": "node", "namespace": "n.s", "fields": [
        {"name": "u", "type": ["string", "null", "long"]}, {"name": "e", "type": {"type": "enum", "name": "colour", "symbols": ["RED", "BLUE"]}}, {"name": "h", "type": {"type": "fixed", "name": "two", "size": 2}},
        {"name": "l", "type": {"type": "array", "items": "int"}}, {"name": "ms", "type": {"type": "long", "logicalType": "timestamp-millis"}}, {"name": "again", "type": "colour"}, {"name": "next", "type": ["null", "node"]}]}
    leaf = _zig(1) + _zig(0) + b"zz" + _zig(0) + _zig(0) + _zig(1) + _zig(0)
    first = _zig(2) + _zig(7) + _zig(1) + b"ab" + _zig(-2) + _zig(2) + _zig(3) + _zig(4) + _zig(1) + _zig(5) + _zig(0) + _zig(1500) + _zig(0) + _zig(1) + leaf
    marker = b"m" * 16
    (tmp_path / "f.avro").write_bytes(avro.header(schema, "null", marker) + _zig(1) + _zig(len(first)) + first + marker)
    inner = T.StructType([T.StructField("e", T.StringType()), T.StructField("u", T.StringType())])
    want = T.StructType([T.StructField("u", T.StringType()), T.StructField("e", T.StringType()), T.StructField("h", T.BinaryType()), T.StructField("l", T.ArrayType(T.IntegerType())), T.StructField("ms", T.TimestampType()), T.StructField("again", T.StringType()), T.StructField("next", inner)])
    (r,) = avro.read(spark, str(tmp_path / "f.avro"), want).select("u", "e", "h", "l", F.unix_millis("ms").alias("ms"), "again", "next").collect()
    assert (r.u, r.e, bytes(r.h), r.l, r.ms, r.again, tuple(r.next)) == ("7", "BLUE", b"ab", [3, 4, 5], 1500, "RED", ("RED", None))
    union = T.StructType([T.StructField("u", T.StructType([T.StructField("member0", T.StringType()), T.StructField("member1", T.LongType())]))])
    assert tuple(avro.read(spark, str(tmp_path / "f.avro"), union).first().u) == (None, 7)


@pytest.fixture
def broken(spark, tmp_path):
    path = str(tmp_path / "t")
    avro.write(spark.range(1000).coalesce(1), path, blockBytes="200", codec="deflate")
    (one,) = parts(path)
    data = bytearray(one.read_bytes())
    with one.open("rb") as f:
        blocks = [(o, [r["id"] for r in got]) for o, got in avro.read_blocks(f, "f", 0, len(data), T.StructType([T.StructField("id", T.LongType())]))]
    hit = blocks[3]
    data[hit[0] + 12] ^= 255  # in the data of the fourth block
    data[-5] ^= 255  # the last block's marker
    one.write_bytes(data)
    return path, hit, blocks[-1]


def test_damaged_blocks(spark, broken):
    path, hit, last = broken
    with pytest.raises(Exception, match=f"block at byte {hit[0]}"):
        avro.read(spark, path).collect()
    for split in ("300", "1000000"):
        left = {r.id for r in avro.read(spark, path, badBlocks="skip", splitBytes=split).collect()}
        assert left == set(range(1000)) - set(hit[1]) - set(last[1])
        assert sorted(r.offset for r in avro.damaged(spark, path, splitBytes=split).collect()) == [hit[0], last[0]]


def test_not_a_container(spark, tmp_path):
    (tmp_path / "a.avro").write_bytes(b"PK\x03\x04")
    (tmp_path / "b.avro").write_bytes(b"")
    with pytest.raises(Exception, match="not an Avro container"):
        avro.read(spark, str(tmp_path), readers.RECORD).collect()
    assert avro.read(spark, str(tmp_path), readers.RECORD, badBlocks="skip").collect() == []
    assert avro.damaged(spark, str(tmp_path)).count() == 2


def test_empty_and_overwritten(spark, tmp_path):
    path = str(tmp_path / "t")
    avro.write(spark.createDataFrame([], ALL), path)
    assert avro.read(spark, path).collect() == []
    avro.write(spark.range(3), path, mode="overwrite")
    avro.write(spark.range(3, 5), path)
    assert sorted(r.id for r in avro.read(spark, path).collect()) == [0, 1, 2, 3, 4]
    assert not (Path(path) / "_temporary").exists() and (Path(path) / "_SUCCESS").exists()


def test_failed_job_leaves_nothing(spark, tmp_path):
    """A task that was still writing may leave a file that no reader sees."""
    path = str(tmp_path / "t")
    with pytest.raises(Exception):
        avro.write(spark.range(100).repartition(4).selectExpr("id", "if(id = 77, raise_error('stop'), 'x') s"), path)
    assert not Path(path).exists() or avro._files(path) == []


def test_batch_archive(spark, tmp_path):
    """Archives as the catalogue gets them: containers in a zip, nested and flat, one field missing."""
    item = T.StructType([f for f in readers.ITEM if f.name != "rights"])
    nested = spark.createDataFrame([("r1", [("http://a", *["x"] * 12)]), ("r2", [("http://b", *[None] * 12), (" ", *["x"] * 12)])], T.StructType([T.StructField("id", T.StringType()), T.StructField("multimediaItems", T.ArrayType(item))]))
    flat = spark.createDataFrame([("http://c", *["y"] * 12)], item)
    for name, df in (("nested", nested), ("flat", flat)):
        avro.write(df.coalesce(1), str(tmp_path / name))
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.write(parts(tmp_path / name)[0], "data.avro")
    got = ingest.flatten(avro.from_binary(readers.zip_members(spark, str(tmp_path / "nested.zip")), "content", readers.RECORD, "member"))
    assert sorted((r.identifier, r.audience, r.rights) for r in got.collect()) == [("http://a", "x", None), ("http://b", None, None)]
    got = ingest.flatten(avro.from_binary(readers.zip_members(spark, str(tmp_path / "flat.zip")), "content", readers.ITEM))
    assert [(r.identifier, r.title, r.rights) for r in got.collect()] == [("http://c", "y", None)]
    assert readers.batch_records(spark, str(tmp_path / "nested")).count() == 2 and readers.batch_records(spark, str(tmp_path / "flat"), nested=False).first().title == "y"


def test_exported_rows(spark, tmp_path):
    df = spark.createDataFrame([(datetime.datetime(2024, 1, 2, 3, 4, 5), decimal.Decimal("1.5"), ["a", "b"])], "at timestamp, n decimal(5,1), l array<string>")
    sinks.write_avro(df, str(tmp_path / "t"))
    assert tuple(avro.read(spark, str(tmp_path / "t")).first()) == ("02-Jan-2024 03:04:05", 1.5, "a,b")


def test_binary_column_with_nulls(spark):
    assert avro.from_binary(spark.createDataFrame([(None,)], "content binary"), "content", readers.RECORD).collect() == []
