"""Operators of batches, the index and scrolling against plain Python."""

import csv
import io
import itertools
import random
import re
import zipfile
import zlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators import catalogue, merge, scroll, states, tags, textindex
from tidemark.plans.ordered import numbered, with_previous
from tidemark.sources import index_store, sinks, zips
from tidemark.streaming import members


@pytest.fixture
def scattered(spark):
    """Many partitions, so that most keys and runs go over an edge."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# Order within keys


def test_previous_row(spark, scattered):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "b", None]), n, rng.choice(["x", "y", None])) for n in range(400)]
    got = with_previous(spark.createDataFrame(rows, "k string, n int, v string").repartition(7), ["k"], ["n"], "v", "old").collect()
    last, want = {}, set()
    for k, n, v in rows:
        want.add((k, n, v, last.get(k)))
        last[k] = (v,)
    assert {(r.k, r.n, r.v, tuple(r.old) if r.old is not None else None) for r in got} == want and len(got) == 400


def merged(current, incoming, blanks):
    """One item after another."""
    table, first = {k: [dict(a=a, b=b), "kept", 0, 0] for k, a, b in current}, set()
    for k, _, a, b in sorted(incoming, key=lambda r: r[1]):
        if k not in table:
            table[k], first = [dict(a=None, b=None), "new", 0, 0], first | {k}
            fresh = True
        else:
            fresh = False
        row = table[k]
        new = {f: v for f, v in (("a", a), ("b", b)) if blanks == "overwrite" or v not in (None, "")}
        changed = any(row[0][f] != v for f, v in new.items())
        row[0].update(new)
        row[2] += 1
        row[3] += changed and not fresh
        if row[1] != "new":
            row[1] = "updated" if row[3] else "unchanged"
    return sorted(((k, *r[0].values(), *r[1:]) for k, r in table.items()), key=str)


@pytest.mark.parametrize("blanks", ["overwrite", "skip"])
def test_merge_in_order(spark, scattered, blanks):
    rng = random.Random(4)
    value = lambda: rng.choice(["x", "y", "", None])
    current = [(k, value(), value()) for k in [*range(12), None]]
    incoming = [(rng.choice([3, 3, 3, *range(20), None]), n, value(), value()) for n in range(500)]
    got = merge.merge_in_order(
        spark.createDataFrame([(*r, 9) for r in current], "k long, a string, b string, extra int"), spark.createDataFrame(incoming, "k long, n int, a string, b string").repartition(5), ["k"], "n", ["a", "b", "absent"], blanks
    ).collect()
    want = merged(current, incoming, blanks)
    if blanks == "skip":  # a new row's first item makes it, blanks and all
        firsts = {}
        for k, n, a, b in incoming:
            firsts.setdefault(k, (a, b))
        want = [(k, *(v if v is not None or o != "new" or firsts[k][i] != "" else None for i, v in enumerate((a, b))), o, n, u) for k, a, b, o, n, u in want]
    assert sorted(((r.k, r.a, r.b, r.outcome, r["items"], r.updates) for r in got), key=str) == want
    assert all((r.extra is None) == (r.outcome == "new") for r in got)


def test_merge_without_rows(spark):
    current, none = spark.createDataFrame([(1, "a")], "k int, a string"), spark.createDataFrame([], "k int, n int, a string")
    assert [tuple(r) for r in merge.merge_in_order(current, none, ["k"], "n", ["a"]).collect()] == [(1, "a", 0, 0, "kept")]
    assert [tuple(r) for r in merge.merge_in_order(current.limit(0), spark.createDataFrame([(None, 1, None)], "k int, n int, a string"), ["k"], "n", ["a"]).collect()] == [(None, None, 1, 0, "new")]


def test_repeated_and_null_keys(spark):
    old = spark.createDataFrame([("A", 1), (None, 2), ("B", 3)], "k string, v int")
    new = spark.createDataFrame([("A", 10, 2), ("A", 11, 1), (None, 12, 1), ("C", 13, 1), ("C", 14, 2)], "k string, v int, at int")
    assert sorted(map(tuple, merge.upsert(old, new, "k", order="at").collect()), key=str) == [("A", 10), ("B", 3), ("C", 14), (None, 12)]
    assert sorted(map(tuple, merge.insert_missing(old, new, "k", order="at").collect()), key=str) == [("A", 1), ("B", 3), ("C", 13), (None, 2)]
    assert sorted(map(tuple, merge.upsert(merge.upsert(old, new, "k", order="at"), new, "k", order="at").collect()), key=str) == [("A", 10), ("B", 3), ("C", 14), (None, 12)]


def test_numbers_in_a_global_order(spark, scattered):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, None]), n) for n in range(300)]
    got = numbered(spark.createDataFrame(rows, "a int, n int").repartition(9), "a", F.desc("n")).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, -r[1]))
    assert [(r.a, r.n) for r in sorted(got, key=lambda r: r.place)] == want and sorted(r.place for r in got) == list(range(1, 301))
    assert numbered(spark.createDataFrame([], "a int"), "a").collect() == []


def test_recheck_gate(spark):
    now = F.lit("2024-03-10 12:00:00").cast("timestamp")
    failed = spark.sql("SELECT url, timestamp(d) AS date_created FROM VALUES ('a', '2024-03-09'), ('b', '2024-03-01'), ('c', '2023-01-01'), ('d', null) AS t(url, d)")
    urls = lambda **k: [(r.url, r.place, r.wave) for r in sorted(catalogue.recheck_plan(failed, now, 30, wave=1, **k).collect(), key=lambda r: r.place)]
    ago = lambda h: F.timestamp_add("HOUR", F.lit(-h), now)
    both = [("b", 1, 0), ("a", 2, 1)]
    assert urls() == both and urls(last_check=ago(23)) == [] and urls(last_check=ago(23), forced=True) == both and urls(last_check=ago(24)) == both and urls(last_check=F.lit(None).cast("timestamp")) == both


def test_metadata_in_order(spark):
    rows = spark.createDataFrame([(1, "n", "s", "z", 1), (1, "n", "s", "a", 2), (1, "n", "s", "", 3)], "image_id long, name string, source string, value string, at int")
    old = rows.limit(0).drop("at")
    assert [r.value for r in catalogue.upsert_metadata(old, rows, "at").collect()] == ["a"] and [r.value for r in catalogue.upsert_metadata(old, rows).collect()] == ["z"]


def test_transitions(spark, scattered):
    rng = random.Random(8)
    names = [*states.UPLOAD, "nonsense", None]
    rows = [(rng.choice(["hot", "hot", "hot", *"abcdefgh", None]), n, rng.choice(names)) for n in range(1500)]
    df = spark.createDataFrame(rows, "k string, n int, status string").repartition(6)
    at, want, taken = {}, [], Counter()
    for k, n, status in rows:
        before = at.get(k, "UNPACKING")
        legal = status in states.UPLOAD[before]
        at[k] = status if legal else before
        taken[k, not legal] += 1
        want.append((k, n, status, before, at[k], not legal))
    got = states.transitions(df, "k", ["n"], "status").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    ends = {r.k: (r.state, r.taken, r.rejected) for r in states.final_states(df, "k", ["n"], "status").collect()}
    assert ends == {k: (s, taken[k, False], taken[k, True]) for k, s in at.items()}
    assert states.transitions(df.limit(0), "k", ["n"], "status").collect() == []


# The index


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    rows = [(d, " ".join(rng.choice("Red cat, the; of\tblue--Été 9 the THE".split()) for _ in range(rng.randint(0, 40)))) for d in range(150)]
    return rows + [(150, None), (151, ""), (152, "--"), (153, "the cat " * 20_000)]


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    textindex.build(spark.createDataFrame([*texts, (None, "red cat")], "d long, t string"), path, "d", "t", buckets=8, spread=3)
    return textindex.Index(spark, path, buckets=8)


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def opened(df):
    """Files that a scan without an exchange reads."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    return plan.collectLeaves().head().metrics().get("numFiles").get().value()


def starts(texts, phrase):
    p = words(phrase)
    found = {d: [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p] for d, w in ((d, words(t)) for d, t in texts)}
    return {d: s for d, s in found.items() if s and p}


@pytest.mark.parametrize("phrase", ["red cat", "The", "the the", "the the the", "of blue été 9", "cat red of", "absent", "the absent", "", "--"])
def test_phrases(index, texts, phrase):
    assert {r.doc: r.starts for r in index.phrase(phrase).collect()} == starts(texts, phrase)


def test_sets_of_hits(index, texts):
    docs = lambda df: sorted(r.doc for r in df.collect())
    a, b, c = (set(starts(texts, p)) for p in ("red cat", "blue", "9"))
    x, y, z = index.phrase("red cat"), index.word("Blue"), index.word("9")
    assert docs(textindex.any_of(x, y)) == sorted(a | b) and docs(textindex.all_of(x, y, z)) == sorted(a & b & c) and docs(textindex.none_of(y, x, z)) == sorted(b - a - c)
    both = {r.doc: r.starts for r in textindex.all_of(x, y).collect()}
    assert all(s == sorted({*starts(texts, "red cat")[d], *starts(texts, "blue")[d]}) for d, s in both.items())


def test_a_search_opens_its_buckets_only(index):
    plan = index.postings("cat")._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*bucket", plan) and re.search(r"PushedFilters: \[.*(EqualTo|In)\(term", plan)
    assert 0 < opened(index.postings("cat")) <= 3 < opened(index.spark.read.parquet(index.path))  # one bucket, as many files as it is spread over


def shuffled(spark, run):
    """Rows that the stages of a run write to shuffles."""
    store, ids = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in (lambda l: [l.apply(i) for i in range(l.size())])(store.stageList(None, False, False, ids, None))}
    before = stages()
    run()
    return sum(n for k, n in stages().items() if k not in before)


def test_postings_are_shuffled_in_blocks(spark, texts, tmp_path):
    """Far fewer rows than words, and once; rows that share an id, in one block or several, are one document."""
    rows = [t for t in texts if t[0] < 150] + [(7, "red cat"), (7, "the cat red cat")]
    df = spark.createDataFrame(rows, "d long, t string").repartition(5)
    n = shuffled(spark, lambda: textindex.build(df, str(tmp_path / "i"), "d", "t", buckets=8, spread=3))
    assert n - len(rows) < 5 * 8 * 3 < sum(len(words(t)) for _, t in rows) / 10  # the table itself is dealt out by the test
    at = {}
    for d, t in rows:
        for k, w in enumerate(words(t)):
            at.setdefault((w, d), []).append(k)
    got = [((r.term, r.doc), r.positions) for r in spark.read.parquet(str(tmp_path / "i")).collect()]
    assert len(got) == len(at) and dict(got) == {k: sorted(v) for k, v in at.items()}


def test_fragments(spark, index, texts):
    got = {}
    for r in textindex.fragments(spark.createDataFrame(texts, "d long, t string"), index.phrase("the the"), "d", "t", size=7, most=2).collect():
        got.setdefault(r.doc, []).append((r.place, r.n, r.fragment))
    for d, hits in starts(texts, "the the").items():
        w = words(dict(texts)[d])
        cells = sorted(Counter(i // 7 for i in hits).items(), key=lambda c: (-c[1], c[0]))[:2]
        assert sorted(got.pop(d)) == sorted((c, n, " ".join(f"<b>{x}</b>" if i in hits else x for i, x in enumerate(w[7 * c : 7 * c + 7], 7 * c))) for c, n in cells)
    assert not got


def test_fragments_join_texts(spark, index, texts):
    """Texts meet the hits; their words, which take more room in a shuffle, are made after that."""
    plan = textindex.fragments(spark.createDataFrame(texts, "d long, t string"), index.phrase("the the"), "d", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan.split("Join")[0] and "regexp_extract_all" not in plan.split("Join", 1)[1]


# Scrolling


@pytest.mark.parametrize("size, part", [(1, 7), (13, 10), (50, 10), (1000, 64)])
def test_all_pages_are_the_table_once(spark, tmp_path, size, part):
    """Equal dates, null dates and ties, and rows that repeat a key and come on one page."""
    rng = random.Random(size)
    rows = [(n, rng.choice([1, 2, 3, None, 10 + n % 9]), rng.choice(["a", "b", None, f"t{n}"])) for n in range(90 if size == 1 else 200)]
    df = spark.createDataFrame(rows, "id int, day int, tie string").withColumn("day", F.timestamp_seconds("day"))
    path = str(tmp_path / "t")
    scroll.lay_out(df, path, "day", "tie", part=part)
    cursor, seen, keys = None, [], []
    for _ in range(300):
        page, cursor = scroll.page(spark, path, "day", "tie", size, cursor)
        if cursor is None:
            break
        found = page.select("id", F.unix_seconds("day").alias("day"), "tie").collect()
        seen += [r.id for r in found]
        order = lambda r: (r.day is None, -(r.day or 0), r.tie is None, r.tie or "")
        assert len({order(r) for r in found}) <= size
        keys += sorted({order(r) for r in found})
    assert sorted(seen) == list(range(len(rows))) and keys == sorted(keys) and len(set(keys)) == len(keys)


def test_a_page_opens_few_files(spark, tmp_path):
    df = spark.range(5000).select("id", F.timestamp_seconds(F.col("id") * 10).alias("day"), F.col("id").cast("string").alias("tie"))
    path = str(tmp_path / "t")
    scroll.lay_out(df, path, "day", "tie", part=100)
    _, first = scroll.page(spark, path, "day", "tie", 30)
    middle = scroll.Cursor(df.where("id = 2500").first().day, "2500")
    page, _ = scroll.page(spark, path, "day", "tie", 30, middle)
    assert opened(spark.read.parquet(f"{path}/rows")) == 50 and opened(page) <= 2
    assert "PartitionFilters: [" in page._jdf.queryExecution().toString()
    assert sorted(r.id for r in page.collect()) == list(range(2470, 2500)) and first.tie == "4970"
    assert scroll.page(spark, path, "day", "tie", 5, scroll.Cursor(None, None))[1] is None


def test_empty_layout(spark, tmp_path):
    scroll.lay_out(spark.createDataFrame([], "id int, day timestamp, tie string"), str(tmp_path / "t"), "day", "tie")
    rows, cursor = scroll.page(spark, str(tmp_path / "t"), "day", "tie", 5)
    assert cursor is None and rows.collect() == []


# Harvest


def test_harvest(spark):
    images = spark.createDataFrame([(2, "two", True), (1, "one", True), (3, "three", False), (4, "four", True)], "id long, image_identifier string, harvestable boolean")
    items = [
        (10, 2, "colour", "red", "UserDefined"), (11, 1, "size", "", "UserDefined"), (12, 1, "shape", "round", "SystemDefined"), (13, 2, "colour", "blue", "UserDefined"), (14, 2, "colour", None, "UserDefined"),
        (15, 1, "Colour", "x", "Embedded"), (16, 3, "weight", "9", "UserDefined"), (17, 2, "odd `name`", "v", "UserDefined"), (18, 1, "colour", "green", "SystemDefined"), (19, None, "none", "v", "UserDefined"),
    ]
    metadata = spark.createDataFrame(items, "id long, image_id long, name string, value string, source string")
    table = catalogue.harvest(images, metadata, "id", F.concat(F.lit("u/"), "image_identifier"))
    assert table.columns == ["imageUrl", "occurrenceId", "shape", "colour", "odd `name`"]  # image 1 is met first
    assert sorted(map(tuple, table.collect())) == [("u/four", "four", "", "", ""), ("u/one", "one", "round", "green", ""), ("u/two", "two", "", "blue", "v")]
    assert catalogue.harvest(images, metadata.limit(0), "id", F.lit("u")).columns == ["imageUrl", "occurrenceId"]
    with pytest.raises(ValueError, match="more than 2 names"):
        catalogue.harvest(images, metadata, "id", F.lit("u"), most=2)


# Nested tags


def test_nested_tags(spark):
    import json

    paths = ["/a", "/a/b/c", "/a/b-x", "/d/e", "/f", 'q"uote/ü', "/a/b/c/d/e/f"]
    df = spark.createDataFrame(list(enumerate(paths)), "id long, path string")

    def tree(rows):
        """What the reference's loop makes of tags in the order of their paths."""
        root = {"children": []}
        for number, path in sorted(rows, key=lambda r: "/" + r[1].lstrip("/")):
            parent, bits = root, path.lstrip("/").split("/")
            for i, bit in enumerate(bits):
                child = next((c for c in parent["children"] if c["name"] == bit), None)
                if child is None:
                    child = {"name": bit, "text": bit, "children": [], "icon": False, "tagId": number, "state": {"disabled": i < len(bits) - 1}}
                    parent["children"].append(child)
                parent = child
        return {c["name"]: c for c in root["children"]}

    assert {r.name: json.loads(r.node) for r in tags.nested(df).collect()} == tree(list(enumerate(paths)))
    assert {r.name: json.loads(r.node) for r in tags.nested(df, "B/C").collect()} == tree([r for r in enumerate(paths) if "b/c" in r[1]])
    assert tags.nested(df.limit(0)).collect() == []


# The index store


def files_of(root):
    return {p: p.stat().st_mtime_ns for p in Path(root, "data").rglob("*.parquet")}


def test_only_changed_buckets_are_written(spark, tmp_path):
    root, bucket = str(tmp_path / "i"), F.floor(F.col("id") / 10)
    rows = spark.range(2000).select("id", F.concat(F.lit("t"), "id").alias("title"), F.when(F.col("id") % 2 == 0, F.array("id")).alias("more"))
    assert index_store.read(spark, root) is None and index_store.latest(spark, root) == 0
    assert index_store.publish(rows, root, bucket) == {"buckets": 200, "written": 200, "gone": 0}
    before = files_of(root)
    later = rows.withColumn("title", F.when(F.col("id").between(500, 519), "new").otherwise(F.col("title")))  # 1 % of the rows
    assert index_store.publish(later, root, bucket) == {"buckets": 200, "written": 2, "gone": 0}
    assert len(files_of(root)) - len(before) <= 0.03 * len(before) and all(files_of(root)[p] == t for p, t in before.items())
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(index_store.read(spark, root), later) and same(index_store.read(spark, root, 1), rows)
    assert index_store.publish(later.repartition(3), root, bucket)["written"] == 0
    assert index_store.publish(later.where("id >= 25"), root, bucket) == {"buckets": 198, "written": 1, "gone": 2}
    assert index_store.read(spark, root).count() == 1975
    wider = later.withColumn("extra", F.lit(1))
    assert index_store.publish(wider, root, bucket)["written"] == 200 and same(index_store.read(spark, root), wider)  # other columns: all anew


def test_a_reader_never_sees_half(spark, tmp_path, monkeypatch):
    """Data without a mark, as an interrupted job leaves them, are not read and are in nobody's way."""
    root, bucket = str(tmp_path / "i"), F.col("id") % 3
    index_store.publish(spark.range(30), root, bucket)
    real = index_store.cut

    class Stopped(Exception):
        pass

    def stop(df):
        real(df).coalesce(1).write.parquet(f"{root}/manifest/half")
        raise Stopped

    monkeypatch.setattr(index_store, "cut", stop)
    with pytest.raises(Stopped):
        index_store.publish(spark.range(31), root, bucket)
    monkeypatch.undo()
    assert sorted(r.id for r in index_store.read(spark, root).collect()) == list(range(30))
    assert index_store.publish(spark.range(31), root, bucket, base=1)["written"] == 1
    with pytest.raises(RuntimeError, match="at state 2, not 1"):
        index_store.publish(spark.range(32), root, bucket, base=1)
    assert index_store.read(spark, root).count() == 31


def test_index_of_odd_rows(spark, tmp_path):
    root = str(tmp_path / "i")
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (None, "b")], "id long, bucket string")
    index_store.publish(rows, root, F.col("id"))
    assert sorted(map(str, index_store.read(spark, root).collect())) == sorted(map(str, rows.collect()))
    index_store.publish(rows.limit(0), root, F.col("id"))
    assert index_store.read(spark, root).collect() == [] and index_store.latest(spark, root) == 2


# Zip


def test_checksums_combine():
    a, b = b"first\x00" * 99, b"second"
    for x, y in itertools.product((a, b, b""), repeat=2):
        assert zips.crc_of_both(zlib.crc32(x), zlib.crc32(y), len(y)) == zlib.crc32(x + y)


@pytest.mark.parametrize("partitions, rows", [(1, 5), (7, 5000), (5, 3), (3, 0)])
def test_zip_from_runs(spark, tmp_path, partitions, rows):
    df = spark.range(0, rows, 1, partitions).select(F.concat(F.lit("é,\"\n"), "id").alias("b"), "id", F.when(F.col("id") % 2 == 0, "x").alias("imageURL"))
    files = zips.write_zip(df, str(tmp_path / "parts"), "images.csv")
    zips.join(str(tmp_path / "parts"), files, str(tmp_path / "out.zip"))
    sinks.download_zip(df, str(tmp_path / "again.zip"))
    for name in ("out.zip", "again.zip"):
        with zipfile.ZipFile(tmp_path / name) as z:
            assert z.testzip() is None and z.namelist() == ["images.csv"]
            got = list(csv.reader(io.StringIO(z.read("images.csv").decode(), newline="")))
        assert got == [["imageURL", "b", "id"]] + [["" if k % 2 else "x", f'é,"\n{k}', str(k)] for k in range(rows)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["again.zip", "out.zip", "parts"]


# Streams


def archive(path, contents):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in contents.items():
            z.writestr(zipfile.ZipInfo(name), data)


@pytest.mark.parametrize("late", [None, "30 days"])
def test_archives_sent_again(spark, tmp_path, late):
    """In one micro-batch, in a later one, and after a restart: what came before adds nothing."""
    inbox, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    inbox.mkdir()
    archive(inbox / "1.zip", {"a.avro": b"one", "b.avro": b"two", "c.txt": b"no"})
    archive(inbox / "2.zip", {"a.avro": b"one", "b.avro": b"two", "c.txt": b"no"})
    archive(inbox / "3.zip", {"x.avro": b"two", "y.avro": b"three"})

    def run():
        fresh = members.new_archives(members.archives(spark, str(inbox)), late)
        query = members.new_members(fresh, late=late) if late is None else members.new_members(members.archives(spark, str(inbox)), late=late)
        stream = query.select("member", "md5", F.col("content").cast("string").alias("text")).writeStream.format("parquet").option("path", out).option("checkpointLocation", check)
        stream.trigger(availableNow=True).start().awaitTermination()
        return sorted(r.text for r in spark.read.parquet(out).collect())

    assert run() == ["one", "three", "two"]
    archive(inbox / "4.zip", {"again.avro": b"three"})
    archive(inbox / "5.zip", {"a.avro": b"one", "new.avro": b"four"})
    assert run() == ["four", "one", "three", "two"]
    assert run() == ["four", "one", "three", "two"]
