import pytest
from pyspark.sql import functions as F

from tidemark.operators import catalogue, ingest, merge, search, tags
from tidemark.operators.search import Criterion
from tidemark.plans.rows import packed, unpacked


def ids(df):
    return sorted(r[0] for r in df.collect())


@pytest.fixture(scope="module")
def things(spark):
    return spark.createDataFrame([(1, "Red Cat", 5, 2.0), (2, "blue dog", 7, None), (3, None, 9, 4.5), (4, "cat-like dog", 5, 1.0)], "id long, t string, n int, x double")


def test_has_words(things):
    got = lambda c: ids(things.where(c).select("id"))
    assert got(search.has_words("t", "CAT")) == [1, 4]
    assert got(search.has_words("t", "cat like")) == [4]
    assert got(search.has_words("t", "ca")) == []
    assert got(~search.has_words("t", "cat") | (F.col("n") == 9)) == [2, 3]


def test_dialects(things):
    p = lambda *a, **k: ids(things.where(search.predicate(*a, **k)).select("id"))
    assert p(Criterion("n", "integer", "gt 5")) == [2, 3]
    assert p(Criterion("n", "integer", "gt 5"), dialect="index") == [1, 2, 3, 4]
    assert p(Criterion("x", "double", "gt 2.0")) == [1, 3]
    assert p(Criterion("t", "string", "red%")) == [1]
    assert p(Criterion("t", "string", "red cat~BLUE DOG"), dialect="index") == [1, 2]
    assert p(Criterion("t", "string", "red cat~blue dog"), dialect="index", mode="all") == []
    with pytest.raises(ValueError):
        search.predicate(Criterion("n", "integer", "about 5"))


def test_pages(spark):
    df = spark.range(300).select(F.col("id").alias("date_uploaded"), F.col("id").alias("image_identifier"))
    assert search.page(df).count() == 10
    assert search.page(df, 500).count() == 200
    assert [r.date_uploaded for r in search.page(df, 2, 1).collect()] == [298, 297]
    assert search.page(df, 10, 20_000).count() == 0


def test_criteria_list():
    s = search.CriteriaList()
    k = s.add(Criterion("n", "integer", "eq 1"))
    s.add(Criterion("t", "string", "a|b"))
    s.replace(k, "bt 1:2")
    assert [search.describe(c) for c in s.all()] == ["n is between 1 and 2", "t is one of a, b"]
    assert set(s.by_kind()) == {"integer", "string"}
    s.remove(k)
    s.clear()
    assert s.all() == []
    assert search.encode_value("integer", {"op": "bt", "value": "1", "value2": "3"}) == "bt 1:3"


def test_tags(spark):
    links = spark.createDataFrame([(1, "/a"), (1, "/a/b"), (1, "/a/b/c"), (1, "/a/d"), (2, "/a"), (2, "/a/b")], "image_id long, path string")
    left = tags.detach(links, spark.createDataFrame([(1, "/a/b/c"), (2, "/a/b")], "image_id long, path string"))
    assert sorted(map(tuple, left.collect())) == [(1, "/a"), (1, "/a/d")]
    assert ids(tags.leaves(links, "image_id").where("image_id = 1").select("path")) == ["/a/b/c", "/a/d"]
    new = tags.create(links.select("path").distinct(), spark.createDataFrame([("A/X/y",)], "path string"))
    assert ids(new) == ["/a/x", "/a/x/y"]


def test_ingest(spark):
    nested = spark.createDataFrame([("r", [("u1", "t1"), ("", "t2"), ("u1", "t3")])], "id string, multimediaItems array<struct<identifier string, title string>>")
    flat = ingest.flatten(nested)
    assert flat.count() == 2 and set(ingest.FIELDS) <= set(flat.columns)
    assert ingest.first_per_identifier(flat, "title").first().title == "t1"
    items = spark.createDataFrame([("a", "m1"), ("b", "m1"), ("c", "m2"), ("d", "m3"), ("e", "m4")], "identifier string, md5 string")
    have = spark.createDataFrame([("c", "m2"), ("z", "m3")], "url string, md5 string")
    failed = spark.createDataFrame([("e",)], "url string")
    out = ingest.classify(items, have, failed)
    assert {r.identifier: r.outcome for r in out.collect()} == {"a": "new", "b": "repeated", "c": "existing", "d": "duplicate", "e": "bad"}
    assert tuple(ingest.counters(out).first()) == (1, 1, 3)


def test_items_without_a_digest(spark):
    items = spark.createDataFrame([("a", None), ("b", None), ("c", None), ("d", "m")], "identifier string, md5 string")
    have = spark.createDataFrame([("c", None)], "url string, md5 string")
    failed = spark.createDataFrame([("b",)], "url string")
    out = ingest.classify(items, have, failed)
    assert {r.identifier: r.outcome for r in out.collect()} == {"a": "unread", "b": "bad", "c": "existing", "d": "new"}
    assert tuple(ingest.counters(out).first()) == (2, 1, 1)


def test_null_and_repeated_keys(spark):
    schema = "image_id long, name string, source string, value string"
    old = spark.createDataFrame([(1, "n", None, "a"), (2, "n", "s", "b")], schema)
    new = spark.createDataFrame([(1, "n", None, "c"), (2, "n", "s", "x"), (2, "n", "s", "y"), (None, "n", "s", "z")], schema)
    assert sorted(map(tuple, catalogue.upsert_metadata(old, new).collect()), key=str) == sorted([(1, "n", None, "c"), (2, "n", "s", "y"), (None, "n", "s", "z")], key=str)
    rows = spark.createDataFrame([(1, "a"), (None, "b")], "id long, v string")
    more = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "id long, v string")
    got = ingest.update_fields(rows, more, "id", ["v"], nulls_overwrite=True).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "y", True), (None, "b", False)], key=str)


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    assert sorted(map(tuple, merge.upsert(old, new, "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, merge.insert_missing(old, new, "id").collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(map(tuple, ingest.set_status(old.withColumn("status", F.lit("x")), "id", 1, "y").select("id", "status").collect())) == [(1, "y"), (2, "x")]


def test_retention(spark):
    files = spark.sql("SELECT * FROM VALUES (1, 'COMPLETE', timestamp'2020-01-01'), (2, 'COMPLETE', timestamp'2020-03-01'), (3, 'QUEUED', null) AS t(upload_id, status, date_completed)")
    uploads = spark.sql("SELECT * FROM VALUES (1), (2), (3), (4) AS t(id)")
    kept, stay = ingest.retained(uploads, files, F.lit("2020-03-10").cast("timestamp"), 30)
    assert ids(kept) == [2, 3] and stay.count() == 2


def test_packed_rows(spark):
    """Names that clash, dots and backticks, maps in any depth; equal rows have one key, and a null differs from an empty text."""
    df = spark.sql("SELECT * FROM VALUES (1, 'a', map('x', 1)), (1, 'a', map('x', 1)), (1, '', map('x', 1)), (1, null, map('x', 1)), (1, 'a', map('x', 2)), (null, 'a', null) AS t(key, row, m)")
    df = df.withColumn("a.b", F.array(F.struct(F.create_map(F.lit(1), F.lit("v"))))).withColumn("c`d", F.lit(0))
    rows = packed(df)
    assert rows.columns == ["key", "row"] and rows.select("key").distinct().count() == 5 and {len(r.key) for r in rows.collect()} == {32}
    back = unpacked(rows, df)
    assert back.columns == df.columns and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
