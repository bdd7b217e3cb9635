"""Registered queries of batches, the index and scrolling: what is written, read back and merged in order."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import catalogue, ingest, merge, optimise, scroll, states, tags, textindex
from tidemark.plans.lineage import new_table_path
from tidemark.queries import NOW, at, query
from tidemark.sources import avro, index_store, readers
from tidemark.sources.adapter import HOST

# Avro containers (SC8, SC9, SK4)

_ITEM = {"identifier": "original_filename", "audience": "audience", "contributor": "contributor", "created": "created", "creator": "creator", "description": "description", "license": "license", "publisher": "publisher", "rightsHolder": "rights_holder", "source": "source", "title": "title", "type": "type"}


@query(
    f"""SELECT identifier, audience, contributor, created, creator, description, license, publisher, NULL::VARCHAR AS "references", NULL::VARCHAR AS rights, "rightsHolder", source, title, type FROM (
        SELECT {", ".join(f'{c} AS "{n}"' for n, c in _ITEM.items())} FROM image
        UNION ALL SELECT {", ".join(f'alternate_filename[1] AS "{n}"' if n == "identifier" else f'{c} AS "{n}"' for n, c in _ITEM.items())} FROM image WHERE id % 3 = 0
    )""",
    "image",
)
def avro_batch(c):
    """Every image, and its alternate file, as items of a batch that goes through containers; two fields are not in their schema."""
    item = lambda **other: F.struct(*(F.col(other.get(n, col)).alias(n) for n, col in _ITEM.items()))
    rows = c["image"].withColumn("alternate", F.get("alternate_filename", F.lit(0)))
    records = rows.select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, F.array(item(), item(identifier="alternate"))).otherwise(F.array(item())).alias("multimediaItems"))
    path = new_table_path(c.spark, "batch")
    avro.write(records, path, recordName="multimediaRecord")
    back = avro.read(c.spark, path, readers.RECORD, splitBytes=str(1 << 20))
    return ingest.flatten(back)


# Free text over an index (FL11, FN37)


def _index(c) -> textindex.Index:
    """The index of all documents, in as many buckets as their number asks for."""
    path, docs = new_table_path(c.spark, "text-index"), c.spark.read.parquet(f"{c.sf_dir}/documents.parquet")
    buckets = max(8, min(4096, docs.count() // 2000))
    textindex.build(docs, path, "doc_id", "text", buckets=buckets, spread=2)
    return textindex.Index(c.spark, path, buckets)


_WORDS = "SELECT doc_id AS doc, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents"
_PHRASE = "list_filter(range(len(w)), lambda i: w[i + 1] = 'of' AND w[i + 2] = 'the')"


@query(f"SELECT doc, starts::VARCHAR AS starts FROM (SELECT doc, {_PHRASE} AS starts FROM ({_WORDS})) WHERE len(starts) > 0")
def phrase_search(c):
    """Documents with the words "of the" next to each other, and where."""
    return _index(c).phrase("Of the").select("doc", F.concat(F.lit("["), F.array_join("starts", ", "), F.lit("]")).alias("starts"))


@query(f"SELECT doc FROM ({_WORDS}) WHERE (len({_PHRASE}) > 0 OR list_contains(w, 'licensed')) AND list_contains(w, 'and') AND NOT list_contains(w, 'idiot')")
def boolean_search(c):
    """("of the" or licensed) and "and", but not idiot."""
    i = _index(c)
    found = textindex.all_of(textindex.any_of(i.phrase("of the"), i.word("licensed")), i.word("and"))
    return textindex.none_of(found, i.word("idiot")).select("doc")


@query(
    f"""WITH hit AS (SELECT doc, w, unnest({_PHRASE}) AS p FROM ({_WORDS})), cell AS (SELECT doc, any_value(w) AS w, p // 12 AS place, count(*) AS n FROM hit GROUP BY doc, place),
    best AS (SELECT * FROM cell QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC, place) <= 2)
    SELECT doc, place, n, array_to_string([CASE WHEN w[b.place * 12 + k] = 'of' AND w[b.place * 12 + k + 1] = 'the' THEN '<b>' || w[b.place * 12 + k] || '</b>' ELSE w[b.place * 12 + k] END FOR k IN range(1, least(12, len(w) - b.place * 12) + 1)], ' ') AS fragment FROM best b"""
)
def best_fragments(c):
    """The two runs of words of each document that hold the phrase most often."""
    docs = c.spark.read.parquet(f"{c.sf_dir}/documents.parquet")
    return textindex.fragments(docs, _index(c).phrase("of the"), "doc_id", "text").select("doc", F.col("place").cast("long").alias("place"), F.col("n").cast("long").alias("n"), "fragment")


# Scrolling (SC19, SL3)


@query(
    """SELECT page, id, image_identifier FROM (SELECT id, image_identifier, 1 + (row_number() OVER (ORDER BY date_uploaded DESC, image_identifier) - 1) // 120 AS page FROM image WHERE date_deleted IS NULL) WHERE page <= 5""",
    "image",
)
def scroll_pages(c):
    """The first five pages of 120 images, each from where the one before ended, over a layout of the whole catalogue."""
    path, cursor, pages = new_table_path(c.spark, "scroll"), None, []
    scroll.lay_out(c["image"].where(F.col("date_deleted").isNull()).select("id", "image_identifier", "date_uploaded"), path, "date_uploaded", "image_identifier", part=1000)
    for number in range(1, 6):
        rows, cursor = scroll.page(c.spark, path, "date_uploaded", "image_identifier", 120, cursor)
        pages.append(rows.select(F.lit(number).cast("long").alias("page"), "id", "image_identifier"))
        if cursor is None:
            break
    return functools.reduce(DataFrame.unionByName, pages)


# The harvest table (AG10, SK13)


@query(
    """, m AS (SELECT l.* FROM metadata_log l JOIN image i ON i.id = l.image_id WHERE i.harvestable AND l.source IN ('SystemDefined', 'UserDefined') AND l.value <> '')
    SELECT name, row_number() OVER (ORDER BY first, name) AS place FROM (SELECT name, min((image_id, id)) AS first FROM m GROUP BY name)""",
    "image", "metadata_log",
)
def harvest_columns(c):
    return catalogue.harvest_names(c["image"], c["metadata_log"], "id").withColumn("place", F.col("place").cast("long"))


_KINDS = ("click", "view", "signup", "purchase", "error")


@query(
    f""", m AS (SELECT * FROM metadata_log WHERE source IN ('SystemDefined', 'UserDefined') AND value <> ''), wide AS (SELECT image_id, {", ".join(f"arg_max(value, id) FILTER (name = '{k}') AS {k}" for k in _KINDS)} FROM m GROUP BY 1)
    SELECT '{HOST}/image/' || image_identifier AS "imageUrl", image_identifier AS "occurrenceId", {", ".join(f"coalesce({k}, '') AS {k}" for k in _KINDS)} FROM image LEFT JOIN wide ON image_id = id WHERE harvestable""",
    "image", "metadata_log",
)
def harvest_table(c):
    return catalogue.harvest(c["image"], c["metadata_log"], "id", F.concat(F.lit(f"{HOST}/image/"), "image_identifier"))


# Merging in order (MU1, MU5, MU6, JN21, MU9, MU10, MU18)

def _batch(c) -> tuple[DataFrame, DataFrame]:
    current = c["image"].where("id % 2 = 0").select("id", "audience", "publisher")
    return current, c["batch_log"].select(F.col("image_id").alias("id"), F.col("id").alias("seq"), "audience", "publisher")


@query(
    """, cur AS (SELECT id, audience, publisher, true AS old FROM image WHERE id % 2 = 0), inc AS (SELECT image_id AS id, id AS seq, audience, publisher FROM batch_log),
    step AS (SELECT *, lag(audience) OVER w AS a, lag(publisher) OVER w AS p, row_number() OVER w AS r FROM (SELECT id, seq, audience, publisher FROM inc UNION ALL SELECT id, -1, audience, publisher FROM cur) WINDOW w AS (PARTITION BY id ORDER BY seq)),
    done AS (SELECT id, count(*) FILTER (seq >= 0) AS items, count(*) FILTER (seq >= 0 AND r > 1 AND (a IS DISTINCT FROM audience OR p IS DISTINCT FROM publisher)) AS updates,
        last(audience ORDER BY seq) AS audience, last(publisher ORDER BY seq) AS publisher, min(seq) = -1 AS old FROM step GROUP BY id)
    SELECT id, audience, publisher, items, updates, CASE WHEN items = 0 THEN 'kept' WHEN NOT old THEN 'new' WHEN updates > 0 THEN 'updated' ELSE 'unchanged' END AS outcome FROM done""",
    "image", "batch_log",
)
def merge_batch(c):
    """Items of a batch one after another: each sets both fields, nulls too."""
    current, incoming = _batch(c)
    return merge.merge_in_order(current, incoming, ["id"], "seq", ["audience", "publisher"])


@query(
    """, cur AS (SELECT id, audience, publisher FROM image WHERE id % 2 = 0), inc AS (SELECT image_id AS id, id AS seq, audience, publisher FROM batch_log),
    every AS (SELECT id, seq, audience, publisher, true AS item FROM inc UNION ALL SELECT id, -1, audience, publisher, false FROM cur),
    first AS (SELECT *, seq = min(seq) OVER (PARTITION BY id) AS begins FROM every),
    cell AS (SELECT id, seq, item, begins, unnest(['audience', 'publisher']) AS f, unnest([audience, publisher]) AS v FROM first),
    step AS (SELECT *, lag(v) OVER w AS before FROM cell WHERE begins OR (v IS NOT NULL AND v <> '') WINDOW w AS (PARTITION BY id, f ORDER BY seq)),
    updates AS (SELECT id, count(DISTINCT seq) AS updates FROM step WHERE NOT begins AND before IS DISTINCT FROM v GROUP BY id),
    done AS (SELECT e.id, count(*) FILTER (item) AS items, bool_or(NOT item) AS old,
        coalesce(arg_max(audience, seq) FILTER (item AND audience IS NOT NULL AND audience <> ''), any_value(audience) FILTER (NOT item)) AS audience,
        coalesce(arg_max(publisher, seq) FILTER (item AND publisher IS NOT NULL AND publisher <> ''), any_value(publisher) FILTER (NOT item)) AS publisher FROM every e GROUP BY e.id)
    SELECT d.id, audience, publisher, items, coalesce(updates, 0) AS updates, CASE WHEN items = 0 THEN 'kept' WHEN NOT old THEN 'new' WHEN coalesce(updates, 0) > 0 THEN 'updated' ELSE 'unchanged' END AS outcome
    FROM done d LEFT JOIN updates u ON u.id IS NOT DISTINCT FROM d.id""",
    "image", "batch_log",
)
def merge_values(c):
    """The same items, each setting only what it holds a value for."""
    current, incoming = _batch(c)
    return merge.merge_in_order(current, incoming, ["id"], "seq", ["audience", "publisher"], blanks="skip")


_NAMED = """, name AS (SELECT url, arg_max(id, (date_uploaded, id)) AS id FROM (SELECT id, date_uploaded, unnest(list_distinct(list_append(coalesce(alternate_filename, []), original_filename))) AS url FROM image) GROUP BY url),
    item AS (SELECT l.*, n.id FROM url_log l LEFT JOIN name n ON n.url = l.identifier WHERE trim(identifier) <> '')"""


@query(
    f"""{_NAMED},
    step AS (SELECT *, lag(audience) OVER w AS a, lag(publisher) OVER w AS p FROM (SELECT id, seq, audience, publisher FROM item WHERE id IS NOT NULL UNION ALL SELECT id, -1, audience, publisher FROM image) WINDOW w AS (PARTITION BY id ORDER BY seq))
    SELECT id, last(audience ORDER BY seq) AS audience, last(publisher ORDER BY seq) AS publisher, count(*) FILTER (seq >= 0) AS items,
        count(*) FILTER (seq >= 0 AND (a IS DISTINCT FROM audience OR p IS DISTINCT FROM publisher)) AS updates FROM step GROUP BY id""",
    "image", "url_log",
)
def batch_on_images(c):
    """Images after a batch whose items name them by their own or alternate URLs."""
    images, items = c["image"].select("id", "image_identifier", "date_uploaded", "original_filename", "alternate_filename", "audience", "publisher"), c["url_log"]
    return ingest.apply_batch(images, items, "seq", ["audience", "publisher"])[0].select("id", "audience", "publisher", "items", "updates")


@query(f"{_NAMED} SELECT identifier, seq FROM item WHERE id IS NULL", "image", "url_log")
def batch_of_new(c):
    """The batch's items whose URL no image has."""
    images = c["image"].select("id", "image_identifier", "date_uploaded", "original_filename", "alternate_filename", "audience", "publisher")
    return ingest.apply_batch(images, c["url_log"], "seq", ["audience", "publisher"])[1].select("identifier", "seq")


@query(
    "SELECT uid, name FROM resource WHERE uid NOT IN (SELECT uid FROM partner WHERE uid IS NOT NULL) UNION ALL SELECT uid, arg_max(name, id) FROM partner GROUP BY uid",
    "resource", "partner",
)
def resource_upsert(c):
    """Many new rows for each key: the last one stays; rows without a key are one."""
    return merge.upsert(c["resource"], c["partner"], "uid", order="id")


@query("SELECT uid, name FROM resource UNION ALL SELECT uid, arg_min(name, id) FROM partner WHERE uid IS NULL OR uid NOT IN (SELECT uid FROM resource) GROUP BY uid", "resource", "partner")
def resource_insert_missing(c):
    return merge.insert_missing(c["resource"], c["partner"], "uid", order="id")


# States (ST10)

_MOVES = ", ".join(f"('{a}', '{b}')" for a, to in states.UPLOAD.items() for b in to)


@query(
    f""", placed AS (SELECT *, row_number() OVER (PARTITION BY upload ORDER BY id) AS r FROM status_event),
    run AS (
        WITH RECURSIVE walk(r, id, upload, status, state_before, state_after) AS (
            SELECT r, id, upload, status, 'UNPACKING', CASE WHEN ('UNPACKING', status) IN ({_MOVES}) THEN status ELSE 'UNPACKING' END FROM placed WHERE r = 1
            UNION ALL SELECT p.r, p.id, p.upload, p.status, w.state_after, CASE WHEN (w.state_after, p.status) IN ({_MOVES}) THEN p.status ELSE w.state_after END FROM walk w JOIN placed p ON p.upload = w.upload AND p.r = w.r + 1
        ) SELECT * FROM walk
    ) SELECT id, upload, status, state_before, state_after, (state_before, status) NOT IN ({_MOVES}) AS rejected FROM run""",
    "status_event",
)
def upload_transitions(c):
    return states.transitions(c["status_event"], "upload", ["id"], "status")


# The recheck of failed URLs (ST5)

_FAILED = "SELECT url, min(date_created) AS date_created, max(http_status) AS http_status FROM failed_upload GROUP BY 1"


@query(
    f"SELECT url, place, (place - 1) // 10 AS wave FROM (SELECT url, row_number() OVER (ORDER BY date_created, url) AS place FROM ({_FAILED}) WHERE date_created >= timestamp '{NOW}' - to_days(12))", "failed_upload"
)
def recheck_plan(c):
    rows = c["failed_upload"].groupBy("url").agg(F.min("date_created").alias("date_created"))
    return catalogue.recheck_plan(rows, at(NOW), 12, last_check=F.timestamp_add("DAY", F.lit(-2), at(NOW))).select("url", "place", "wave")


@query(
    f"SELECT count(*) AS checked, count(*) FILTER (http_status % 2 = 0) AS removed, count(*) FILTER (http_status % 7 = 0) AS errors FROM ({_FAILED}) WHERE date_created >= timestamp '{NOW}' - to_days(12)", "failed_upload"
)
def recheck_counts(c):
    rows = c["failed_upload"].groupBy("url").agg(F.min("date_created").alias("date_created"), F.max("http_status").alias("http_status"))
    checked = catalogue.recheck_failed(rows, rows.where("http_status % 2 = 0"), at(NOW), 12)
    return catalogue.recheck_counts(checked.withColumn("error", F.col("http_status") % 7 == 0))


# Outputs of optimisation tools (MD4), and jobs that ran out of time (ST4)

_STAGES = [optimise.Stage({"minBytes": 9000, "contentTypes": ["image/"]}), optimise.Stage({"minBytesByFormat": {"webp": 20000}}, allow_lossy=True), optimise.Stage({"alpha": True})]


@query(
    f""", r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY stage, step, bytes, ok, lossy, always, larger, target_format NULLS FIRST) AS n FROM tool_result),
    run AS (
        WITH RECURSIVE walk(n, id, width, height, content_type, alpha, stage, inside, bytes, format, taken, warnings) AS (
            SELECT 0, id, width, height, content_type, alpha, CAST(-1 AS BIGINT), false, bytes, format, 0, 0 FROM tool_input WHERE bytes > 5000
            UNION ALL SELECT n, id, width, height, content_type, alpha, stage, inside, CASE WHEN take THEN out ELSE bytes END, CASE WHEN take THEN coalesce(target_format, format) ELSE format END, taken + take::INT, warnings + (ran AND NOT take)::INT FROM (
                SELECT *, ran AND ok AND out > 0 AND (always OR larger OR out <= bytes) AS take FROM (
                    SELECT *, inside AND (NOT lossy OR stage = 1) AS ran FROM (
                        SELECT r.n, w.id, w.width, w.height, w.content_type, w.alpha, r.stage, w.bytes, w.format, w.taken, w.warnings, r.bytes AS out, r.ok, r.lossy, r.always, r.larger, r.target_format,
                            CASE WHEN w.stage = r.stage THEN w.inside WHEN r.stage = 0 THEN w.bytes >= 9000 AND w.content_type LIKE 'image/%' WHEN r.stage = 1 THEN w.format <> 'webp' OR w.bytes >= 20000 ELSE coalesce(w.alpha, false) END AS inside
                        FROM walk w JOIN r ON r.id = w.id AND r.n = w.n + 1))) s
        ) SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC) = 1
    ) SELECT i.id, i.bytes, coalesce(run.bytes, i.bytes) AS bytes_after, coalesce(run.format, i.format) AS format_after, CAST(coalesce(taken, 0) AS BIGINT) AS taken, CAST(coalesce(warnings, 0) AS BIGINT) AS warnings, i.bytes <= 5000 AS skipped FROM tool_input i LEFT JOIN run ON run.id = i.id""",
    "tool_result", "tool_input",
)
def optimised_files(c):
    return optimise.accepted(c["tool_input"], c["tool_result"], _STAGES, skip_bytes=5000)


_LATE = f"date_created + to_minutes(expected_minutes) < timestamp '{NOW}'"


@query(f"SELECT 'left' AS what, id, image_id FROM job WHERE NOT ({_LATE}) UNION ALL SELECT DISTINCT 'queued', NULL, image_id FROM job WHERE {_LATE} AND kind = 'TMSTile'", "job")
def requeued_jobs(c):
    left, queued = ingest.requeue_overdue(c["job"], at(NOW))
    return left.select(F.lit("left").alias("what"), "id", "image_id").unionByName(queued.select(F.lit("queued").alias("what"), F.lit(None).cast("long").alias("id"), "image_id"))


# Nested tags (TG9)

_NODE = """'{{"name":"' || {name} || '","text":"' || {name} || '","children":[' || {children} || '],"icon":false,"tagId":' || {id} || ',"state":{{"disabled":' || CASE WHEN {stored} THEN 'false' ELSE 'true' END || '}}}}'"""


@query(
    f""", p AS (SELECT id, path, string_split(substr(path, 2), '/') AS b FROM deep_tag),
    n3 AS (SELECT b[1] AS a, b[2] AS m, path AS first, {_NODE.format(name="b[3]", children="''", id="CAST(id AS VARCHAR)", stored="true")} AS node FROM p WHERE len(b) = 3),
    n2 AS (SELECT b[1] AS a, b[2] AS m, min(path) AS first, arg_min(id, path) AS id, bool_or(len(b) = 2) AS stored FROM p WHERE len(b) >= 2 GROUP BY 1, 2),
    j2 AS (SELECT a, n2.first, {_NODE.format(name="m", children="coalesce((SELECT string_agg(node, ',' ORDER BY n3.first) FROM n3 WHERE n3.a = n2.a AND n3.m = n2.m), '')", id="CAST(id AS VARCHAR)", stored="stored")} AS node FROM n2),
    n1 AS (SELECT b[1] AS a, arg_min(id, path) AS id, bool_or(len(b) = 1) AS stored FROM p GROUP BY 1)
    SELECT a AS name, {_NODE.format(name="a", children="coalesce((SELECT string_agg(node, ',' ORDER BY j2.first) FROM j2 WHERE j2.a = n1.a), '')", id="CAST(id AS VARCHAR)", stored="stored")} AS node FROM n1""",
    "deep_tag",
)
def nested_tags(c):
    return tags.nested(c["deep_tag"])


# An index updated by buckets (SK7 to SK10)


@query("SELECT id, image_identifier, CASE WHEN id BETWEEN 40 AND 59 THEN 'renamed' ELSE title END AS title, 2 AS states FROM image WHERE id <> 41", "image")
def index_updates(c):
    """The index published twice, the second time with some rows changed and one removed, and read again."""
    rows, root = c["image"].select("id", "image_identifier", "title"), new_table_path(c.spark, "index")
    bucket = F.floor(F.col("id") / max(20, rows.count() // 256))  # ranges of ids, some 256 of them at any size
    index_store.publish(rows, root, bucket)
    later = index_store.read(c.spark, root).where("id <> 41").withColumn("title", F.when(F.col("id").between(40, 59), "renamed").otherwise(F.col("title")))
    index_store.publish(later, root, bucket)
    return index_store.read(c.spark, root).withColumn("states", F.lit(index_store.latest(c.spark, root)).cast("int"))
