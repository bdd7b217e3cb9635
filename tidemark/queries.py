"""Registered queries over the driver's tables, with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import media, text, urls
from tidemark.operators import catalogue, exports, ingest, merge, search, tags
from tidemark.operators.search import Criterion
from tidemark.sources import sinks
from tidemark.sources.adapter import HOST, Catalogue, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, *names: str):
    """Register a function of the catalogue under its name, with an oracle over the relations ``names``."""

    def add(f: Callable[[Catalogue], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Catalogue(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = oracle(sql, *names)
        return f

    return add


def at(now: str):
    return F.to_timestamp(F.lit(now))


LIVE_URLS = "SELECT *, unnest(list_append(coalesce(alternate_filename, []), original_filename)) AS u FROM image WHERE date_deleted IS NULL"
NO_CREDENTIALS = "regexp_replace(u, '://[^/@]+@', '://', 'g')"


def _control(c: str, name: str) -> str:
    return f"nullif(regexp_replace({c}, '[\\x00-\\x1F\\x7F-\\x9F]', '', 'g'), '') AS {name}"


def _line(c: str, name: str) -> str:
    return f"regexp_replace({c}, '[\\n\\r]+', ' ', 'g') AS {name}"


def _clean(c: str, name: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '[|''\"&]+', ''), '[\\n\\r]+', ' ', 'g') AS {name}"


MATCHED = """, matched AS (SELECT i.*, coalesce(
    (SELECT min(l.id) FROM license l WHERE i.license IN (l.acronym, l.name, l.url, l.image_url)),
    (SELECT min(m.license_id) FROM license_mapping m WHERE m.value = i.license)) AS licence_id FROM image i)"""


def _recognised(c: Catalogue) -> DataFrame:
    return catalogue.with_matched_licence(c["image"], c["license"], c["license_mapping"])


@query(f"SELECT data_resource_uid, image_identifier AS \"imageID\", {NO_CREDENTIALS} AS url FROM ({LIVE_URLS}) WHERE data_resource_uid IS NOT NULL", "image")
def export_mapping(c):
    return exports.export_mapping(c["image"])


DATASET = {c: c for c in ("audience", "contributor", "created", "creator", "description", "license", "publisher", "source", "title", "type")} | {"mime_type": "format", "dc_references": '"references"', "rights_holder": '"rightsHolder"'}


@query(
    f"SELECT image_identifier AS \"imageID\", nullif(regexp_replace({NO_CREDENTIALS}, '[\\x00-\\x1F\\x7F-\\x9F]', '', 'g'), '') AS identifier, "
    + ", ".join(_control(c, name) for c, name in DATASET.items())
    + f" FROM ({LIVE_URLS}) WHERE data_resource_uid = 'src3'",
    "image",
)
def export_dataset(c):
    return exports.export_dataset(c["image"], "src3")


@query(f"SELECT image_identifier AS \"imageID\", {NO_CREDENTIALS} AS url FROM ({LIVE_URLS}) WHERE data_resource_uid = 'src4'", "image")
def export_dataset_mapping(c):
    return exports.export_dataset_mapping(c["image"], "src4")


@query(
    MATCHED + f""" SELECT data_resource_uid AS "dataResourceUid", occurrence_id AS "occurrenceID", concat('{HOST}/image/proxyImageThumbnailLarge?imageId=', image_identifier) AS identifier,
    {_line('creator', 'creator')}, strftime(date_taken, '%Y-%m-%d %H:%M:%S') AS created, {_line('title', 'title')}, mime_type AS format, {_line('license', 'license')}, {_line('rights', 'rights')},
    {_line('rights_holder', '"rightsHolder"')}, concat('{HOST}/image/', image_identifier) AS "references", {_line('description', 'description')}, extension,
    l.acronym AS "recognisedLicense", strftime(date_deleted, '%Y-%m-%d %H:%M:%S') AS "dateDeleted", content_md5 AS md5hash, file_size AS "fileSize", width, height, zoom_levels AS "zoomLevels", image_identifier AS "imageIdentifier"
    FROM (SELECT * RENAME (license AS licence_text) FROM matched) i LEFT JOIN (SELECT id AS lid, acronym FROM license) l ON l.lid = i.licence_id""".replace("regexp_replace(license,", "regexp_replace(licence_text,"),
    "image", "license", "license_mapping",
)
def export_images(c):
    return exports.export_images(_recognised(c), c["license"], HOST)


@query(
    MATCHED + f""" SELECT image_identifier AS "imageIdentifier", content_md5 AS contentmd5hash, content_sha1 AS contentsha1hash, mime_type AS format, original_filename AS originalfilename, extension, strftime(date_taken, '%Y-%m-%d') AS "dateTaken",
    {_clean('rights', 'rights')}, {_clean('rights_holder', '"rightsHolder"')}, thumb_height AS "thumbHeight", thumb_width AS "thumbWidth", audience, source, contributor, type, created, dc_references AS "references",
    strftime(date_uploaded, '%Y-%m-%d') AS "dateUploaded", strftime(date_uploaded, '%Y-%m') AS "dateUploadedYearMonth", file_size AS "fileSize", height, width, zoom_levels AS "zoomLevels",
    data_resource_uid AS "dataResourceUid", {_clean('creator', 'creator')}, {_clean('title', 'title')}, {_clean('description', 'description')}, {_clean('licence_text', 'license')},
    l.acronym AS "recognisedLicence", occurrence_id AS "occurrenceID", harvestable,
    CASE WHEN height * width < 100 THEN 'less than 100' WHEN height * width < 1000 THEN 'less than 1k' WHEN height * width < 10000 THEN 'less than 10k' WHEN height * width < 100000 THEN 'less than 100k'
         WHEN height * width < 1000000 THEN 'less than 1m' ELSE CAST((height * width) // 1000000 AS VARCHAR) || 'm' END AS "imageSize",
    CASE WHEN mime_type LIKE 'image%' THEN 'image' WHEN mime_type LIKE 'audio%' THEN 'sound' WHEN mime_type LIKE 'video%' THEN 'video' ELSE 'document' END AS "fileType"
    FROM (SELECT * RENAME (license AS licence_text) FROM matched) i LEFT JOIN (SELECT id AS lid, acronym FROM license) l ON l.lid = i.licence_id WHERE date_deleted IS NULL""",
    "image", "license", "license_mapping",
)
def export_index(c):
    return exports.export_index(_recognised(c), c["license"])


FACETS = ("mime_type", "data_resource_uid", "license", "harvestable")


@query(
    "SELECT facet, value, n FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS r FROM ("
    + " UNION ALL ".join(f"SELECT '{f}' AS facet, CAST({f} AS VARCHAR) AS value, count(*) AS n FROM image WHERE {f} IS NOT NULL AND date_deleted IS NULL GROUP BY 1, 2" for f in FACETS)
    + ")) WHERE r <= 10",
    "image",
)
def facet_all(c):
    return search.facets(exports.live(c["image"]), list(FACETS))


@query("SELECT data_resource_uid AS value, count(*) AS n FROM image WHERE data_resource_uid IS NOT NULL GROUP BY 1", "image")
def facet_single(c):
    return search.facet(c["image"], "data_resource_uid")


@query(
    "SELECT CASE WHEN p < 100 THEN 'less than 100' WHEN p < 1000 THEN 'less than 1k' WHEN p < 10000 THEN 'less than 10k' WHEN p < 100000 THEN 'less than 100k' WHEN p < 1000000 THEN 'less than 1m' "
    "ELSE CAST(p // 1000000 AS VARCHAR) || 'm' END AS size, count(*) AS n FROM (SELECT height * width AS p FROM image) GROUP BY 1",
    "image",
)
def image_size_facet(c):
    return c["image"].groupBy(media.size_bucket("height", "width").alias("size")).agg(F.count("*").alias("n"))


@query(
    "SELECT id, image_identifier, title FROM image WHERE date_deleted IS NULL AND mime_type = 'image/png' AND file_size BETWEEN 200 AND 5000 AND license ILIKE 'cc%' ORDER BY date_uploaded DESC, image_identifier LIMIT 50 OFFSET 5", "image"
)
def search_page(c):
    rows = search.where_all(exports.live(c["image"]), [Criterion("file_size", "integer", "bt 5000:200"), Criterion("license", "string", "cc%")])
    return search.page(search.filter_queries(rows, ["mime_type:image/png", "malformed"]), 50, 5).select("id", "image_identifier", "title")


@query(
    "SELECT id FROM image WHERE file_size > 800 AND height <= width AND data_resource_uid IN ('src1', 'src2', 'src5', 'src7') AND date_uploaded BETWEEN timestamp '2024-01-03' AND timestamp '2024-03-01' "
    "AND id IN (SELECT image_id FROM image_metadata WHERE lower(name) = 'lang' AND value ILIKE 'e%')",
    "image", "image_metadata",
)
def search_criteria_db(c):
    wanted = [
        Criterion("file_size", "integer", "gt 800"),
        Criterion("height", "integer", "lt field(width)"),
        Criterion("data_resource_uid", "string", "src1|src2|src5|src7"),
        Criterion("date_uploaded", "date", "bt 03/01/2024:01/03/2024"),
        Criterion("", "metadata", "lang:e*"),
    ]
    return search.where_all(c["image"], wanted, c["image_metadata"]).select("id")


@query("SELECT id FROM image WHERE file_size >= 800 AND width <= 3000.5 AND lower(data_resource_uid) IN ('src4', 'src8') AND harvestable", "image")
def search_criteria_index(c):
    wanted = [Criterion("file_size", "integer", "gt 800"), Criterion("width", "double", "lt 3000.5"), Criterion("data_resource_uid", "string", "SRC4~src8"), Criterion("harvestable", "boolean", "true")]
    return search.where_all(c["image"], wanted, dialect="index").select("id")


@query(
    "SELECT id FROM image WHERE (list_contains(string_split_regex(lower(license), '\\W+'), 'cc') OR lower(license) = 'cc') AND NOT (data_resource_uid = 'src3' AND data_resource_uid IS NOT NULL) AND width BETWEEN 100 AND 2500", "image"
)
def search_query_string(c):
    return c["image"].where(search.has_words("license", "cc") & ~F.coalesce(F.col("data_resource_uid") == "src3", F.lit(False)) & F.col("width").between(100, 2500)).select("id")


@query("SELECT id, image_identifier FROM image WHERE original_filename ILIKE 'HTTPS://%/1%'", "image")
def by_file_name(c):
    return search.by_file_name(c["image"], "HTTPS%3A//*/1*").select("id", "image_identifier")


@query(
    "SELECT url, id, image_identifier FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY date_uploaded DESC, id DESC) AS r FROM "
    "(SELECT id, image_identifier, date_uploaded, unnest(list_distinct(list_append(coalesce(alternate_filename, []), original_filename))) AS url FROM image)) "
    "WHERE r = 1",
    "image",
)
def by_filename_or_alternate(c):
    urls_of = c["image"].select(F.explode(exports.all_urls()).alias("url"))
    return search.latest_for_url(c["image"], urls_of)


@query("SELECT data_resource_uid AS value, image_identifier FROM image WHERE data_resource_uid IN ('src0', 'src9')", "image")
def grouped_by_value(c):
    return search.grouped_by_value(c["image"], "data_resource_uid", ["src0", "src9"])


@query("SELECT DISTINCT md5(CAST(n_nationkey * 70 AS VARCHAR)) AS image_identifier, md5(CAST(n_nationkey * 70 AS VARCHAR)) IN (SELECT image_identifier FROM image) AS found FROM nation", "image")
def found_and_missing(c):
    ids = c.spark.read.parquet(f"{c.sf_dir}/nation.parquet").select(F.md5((F.col("n_nationkey") * 70).cast("string")).alias("image_identifier"))
    return search.found_and_missing(c["image"], ids)


@query("SELECT content_md5, count(*) AS n, arg_min(image_identifier, id) AS exemplar FROM image GROUP BY 1 HAVING count(*) > 1", "image")
def duplicates(c):
    return catalogue.duplicates(c["image"])


@query(MATCHED + " SELECT id, licence_id FROM matched", "image", "license", "license_mapping")
def licence_match(c):
    return catalogue.match_licence(c["image"], c["license"], c["license_mapping"])


@query(
    ", k AS (SELECT value AS license, license_id, 0 AS p FROM license_mapping UNION ALL SELECT url, id, 1 FROM license UNION ALL SELECT name, id, 2 FROM license UNION ALL SELECT acronym, id, 3 FROM license), "
    "b AS (SELECT license, arg_max(license_id, p) AS new FROM k GROUP BY 1) SELECT i.id, coalesce(b.new, CASE WHEN i.id % 2 = 0 THEN 1 END) AS licence_id FROM image i LEFT JOIN b USING (license)",
    "image", "license", "license_mapping",
)
def licence_rematch(c):
    rows = c["image"].withColumn("recognised_license_id", F.when(F.col("id") % 2 == 0, F.lit(1)))
    return catalogue.rematch_licence(rows, c["license"], c["license_mapping"])


@query(
    "SELECT count(*) AS images, count(date_deleted) AS deleted, count(license) AS licensed, CAST(sum(file_size) AS BIGINT) AS bytes, (SELECT count(*) FROM license) AS licences FROM image", "image", "license"
)
def repository_stats(c):
    return catalogue.repository_stats(c["image"], c["license"])


@query("SELECT storage_location, count(*) AS n FROM image GROUP BY 1", "image")
def counts_by_location(c):
    return catalogue.counts_by(c["image"], "storage_location")


@query(
    "SELECT u.id AS upload_id, u.resource, count(*) AS files, CAST(sum(coalesce(record_count, 0)) AS BIGINT) AS record_count, CAST(sum(coalesce(new_images, 0)) AS BIGINT) AS new_images, "
    "CAST(sum(coalesce(metadata_updates, 0)) AS BIGINT) AS metadata_updates, CAST(sum(coalesce(error_count, 0)) AS BIGINT) AS error_count, "
    + ", ".join(f"count(*) FILTER (status = '{s}') AS {s.lower()}" for s in ("COMPLETE", "LOADING", "QUEUED", "STOPPED"))
    + ", bool_and(status = 'COMPLETE') AS all_complete, bool_and(coalesce(record_count, 0) = 0) AS no_records FROM batch_upload u JOIN batch_file f ON f.upload_id = u.id GROUP BY 1, 2",
    "batch_upload", "batch_file",
)
def batch_rollup(c):
    return catalogue.batch_rollup(c["batch_upload"], c["batch_file"])


@query("SELECT upload_id, file_no, status FROM batch_file WHERE status <> 'COMPLETE'", "batch_file")
def batch_files_in_order(c):
    return catalogue.files_in_order(c["batch_file"]).select("upload_id", "file_no", "status")


@query("SELECT upload_id, file_no FROM batch_file WHERE status = 'QUEUED' ORDER BY date_completed, upload_id, file_no LIMIT 1", "batch_file")
def oldest_queued(c):
    return catalogue.oldest_queued(c["batch_file"]).select("upload_id", "file_no")


@query("SELECT DISTINCT name FROM image_metadata WHERE source = 'UserDefined'", "image_metadata")
def metadata_keys(c):
    return catalogue.metadata_keys(c["image_metadata"], "UserDefined")


@query(
    "SELECT i.id, i.image_identifier, max(CASE name WHEN 'lang' THEN value END) AS lang, max(CASE name WHEN 'quality' THEN value END) AS quality, max(CASE name WHEN 'Toxic' THEN value END) AS \"Toxic\" "
    "FROM image i LEFT JOIN (SELECT * FROM image_metadata WHERE trim(value) <> '') m ON m.image_id = i.id WHERE harvestable GROUP BY 1, 2",
    "image", "image_metadata",
)
def metadata_pivot(c):
    return catalogue.metadata_pivot(c["image"], c["image_metadata"], ["lang", "quality", "Toxic"])


@query("SELECT image_id, value FROM image_metadata WHERE lower(name) = 'toxic' AND source = 'UserDefined' AND image_id IN (SELECT id FROM image WHERE harvestable)", "image", "image_metadata")
def metadata_values(c):
    return catalogue.metadata_values(c["image_metadata"], c["image"].where("harvestable"), "toxic", "UserDefined")


NEW_ITEMS = "SELECT image_id, name, CASE WHEN image_id % 7 <> 0 THEN source END AS source, CASE WHEN image_id % 3 = 0 THEN ' ' ELSE ' new ' || value END AS value FROM image_metadata WHERE image_id % 2 = 0 AND name <> 'Toxic'"


@query(
    f", old AS (SELECT image_id, name, CASE WHEN image_id % 7 <> 0 THEN source END AS source, value FROM image_metadata), n AS (SELECT image_id, name, source, trim(value) AS new FROM ({NEW_ITEMS}) WHERE trim(value) <> '') "
    "SELECT coalesce(m.image_id, n.image_id) AS image_id, coalesce(m.name, n.name) AS name, coalesce(m.source, n.source) AS source, coalesce(n.new, m.value) AS value FROM old m FULL JOIN n "
    "ON m.image_id = n.image_id AND m.name = n.name AND m.source IS NOT DISTINCT FROM n.source",
    "image_metadata",
)
def metadata_upsert(c):
    rows = c["image_metadata"].withColumn("source", F.expr("CASE WHEN image_id % 7 <> 0 THEN source END"))
    new = rows.where("image_id % 2 = 0 AND name <> 'Toxic'").withColumn("value", F.when(F.col("image_id") % 3 == 0, " ").otherwise(F.concat(F.lit(" new "), "value")))
    return catalogue.upsert_metadata(rows, new.unionByName(new))


@query("SELECT image_id, name, source, value FROM image_metadata WHERE NOT (name = 'quality' AND image_id % 5 = 0)", "image_metadata")
def metadata_delete(c):
    rows = c["image_metadata"]
    return catalogue.delete_metadata(rows, rows.where("name = 'quality' AND image_id % 5 = 0")).select("image_id", "name", "source", "value")


NOW = "2024-01-31 00:00:00"
_PERIODS = "(VALUES " + ", ".join(f"('{n}', {d})" for n, d in catalogue.PERIODS) + ") p(period, days)"
_RECENT = f"usage_event JOIN {_PERIODS} ON ts >= timestamp '{NOW}' - to_days(days) AND ts <= timestamp '{NOW}'"


@query(f"SELECT period, category, count(*) AS events, count(DISTINCT user_id) AS users FROM {_RECENT} WHERE resource_uid = 'src3' GROUP BY 1, 2", "usage_event")
def usage_by_category(c):
    return catalogue.usage_by_category(c["usage_event"], "src3", at(NOW))


@query(f"SELECT period, resource_uid, count(*) AS events, count(DISTINCT user_id) AS users FROM {_RECENT} GROUP BY 1, 2", "usage_event")
def usage_by_resource(c):
    return catalogue.usage_by_resource(c["usage_event"], at(NOW))


@query("SELECT url, http_status FROM failed_upload WHERE regexp_matches(url, '/(en|fr)/[0-9]+$')", "failed_upload")
def failed_url_regex(c):
    return catalogue.failed_matching(c["failed_upload"], "/(en|fr)/[0-9]+$").select("url", "http_status")


@query("SELECT page_id FROM pages WHERE url IN (SELECT url FROM failed_upload)", "failed_upload")
def known_failed(c):
    return catalogue.known_failed(c.spark.read.parquet(f"{c.sf_dir}/pages.parquet").select("page_id", "url"), c["failed_upload"]).select("page_id")


@query("SELECT id FROM batch_upload WHERE date_created + to_minutes(CAST(resource * 60 AS BIGINT)) < timestamp '1996-06-01'", "batch_upload")
def expired_jobs(c):
    jobs = c["batch_upload"].withColumn("expected_minutes", F.col("resource") * 60)
    return ingest.overdue(jobs, at("1996-06-01 00:00:00")).select("id")


@query(
    ", f AS (SELECT * FROM batch_file WHERE NOT (status = 'COMPLETE' AND date_completed < timestamp '1996-06-01' - to_days(100))) SELECT id FROM batch_upload WHERE id IN (SELECT upload_id FROM f)", "batch_upload", "batch_file"
)
def retention_survivors(c):
    return ingest.retained(c["batch_upload"], c["batch_file"], at("1996-06-01 00:00:00"), 100)[0].select("id")


PREFIXES = (
    "SELECT DISTINCT '/' || array_to_string(list_slice(parts, 1, k), '/') AS path FROM (SELECT parts, unnest(range(1, len(parts) + 1)) AS k FROM "
    "(SELECT list_filter(string_split(lower(path), '/'), lambda x: x <> '') AS parts FROM tag))"
)


@query(PREFIXES, "tag")
def tag_prefixes(c):
    return tags.create(c["tag"].where("false"), c["tag"])


@query(f", p AS ({PREFIXES}) SELECT path FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE starts_with(q.path, p.path || '/'))", "tag")
def tag_leaves(c):
    return tags.leaves(c["tag"].select(F.explode(tags.prefixes("path")).alias("path")).distinct())


@query("SELECT id, CASE WHEN path = '/asia' OR starts_with(path, '/asia/') THEN '/world/asia' || substr(path, 6) ELSE path END AS path FROM tag", "tag")
def tag_move(c):
    return tags.move(c["tag"], "/asia", "/world").select("id", "path")


@query("SELECT id, CASE WHEN path = '/europe' OR starts_with(path, '/europe/') THEN '/eu' || substr(path, 8) ELSE path END AS path FROM tag", "tag")
def tag_rename(c):
    return tags.rename(c["tag"], "/europe", "EU").select("id", "path")


@query("SELECT id FROM tag WHERE starts_with(path, '/africa/')", "tag")
def tag_subtree(c):
    return tags.subtree(c["tag"], "/Africa").select("id")


@query("SELECT image_id, tag_id FROM image_tag WHERE tag_id NOT IN (SELECT id FROM tag WHERE starts_with(path, '/america/'))", "tag", "image_tag")
def tag_delete(c):
    return tags.delete(c["tag"], c["image_tag"], "/america")[1].select("image_id", "tag_id")


LINKS = "SELECT image_id, path FROM image_tag JOIN tag ON tag.id = tag_id"


def _links(c: Catalogue) -> DataFrame:
    return c["image_tag"].join(c["tag"], F.col("tag_id") == F.col("id")).select("image_id", "path")


@query(
    f", l AS ({LINKS}) SELECT DISTINCT image_id, '/' || split_part(path, '/', 2) AS path FROM l", "tag", "image_tag"
)
def tag_attach(c):
    links = _links(c)
    return tags.attach(links, links)


@query(
    f", l AS ({LINKS} UNION SELECT image_id, '/' || split_part(path, '/', 2) FROM ({LINKS})) SELECT image_id, path FROM l WHERE image_id % 2 = 1 ", "tag", "image_tag"
)
def tag_detach(c):
    direct = _links(c)
    links = direct.select("image_id", F.explode(tags.prefixes("path")).alias("path")).distinct()
    return tags.detach(links, direct.where("image_id % 2 = 0"))


@query(f", l AS ({LINKS}) SELECT DISTINCT image_id, unnest(list_filter(string_split(path, '/'), lambda x: x <> '')) AS keyword FROM l", "tag", "image_tag")
def keywords(c):
    return tags.keywords(_links(c))


@query(f", p AS ({PREFIXES}) SELECT path, regexp_replace(path, '/[^/]*$', '') AS parent, CAST(len(string_split(path, '/')) - 1 AS INTEGER) AS depth, string_split(path, '/')[-1] AS label, path NOT IN (SELECT path FROM tag) AS disabled FROM p", "tag")
def tag_tree(c):
    return tags.tree(c["tag"])


@query(f", l AS ({LINKS}) SELECT id FROM image WHERE id IN (SELECT DISTINCT image_id FROM l WHERE path LIKE '/asia/%' ORDER BY image_id LIMIT 100)", "image", "tag", "image_tag")
def images_by_keyword(c):
    return tags.images_by_keyword(c["image"], tags.keywords(_links(c)), "Asia").select("id")


@query(
    """WITH d AS (SELECT doc_id, 'u' || CAST(doc_id AS VARCHAR) AS identifier, CASE WHEN doc_id % 11 <> 0 THEN md5(text) END AS md5 FROM documents),
    b AS (SELECT identifier, md5 FROM d WHERE doc_id % 2 = 1 OR doc_id % 10 = 0), cat AS (SELECT identifier AS url, md5 FROM d WHERE doc_id % 2 = 0),
    f AS (SELECT md5, min(identifier) AS first FROM b WHERE md5 IS NOT NULL GROUP BY 1)
    SELECT identifier, b.md5, CASE WHEN CAST(substr(identifier, 2) AS BIGINT) % 35 = 0 THEN 'bad' WHEN identifier IN (SELECT url FROM cat) THEN 'existing' WHEN b.md5 IS NULL THEN 'unread'
        WHEN b.md5 IN (SELECT md5 FROM cat WHERE md5 IS NOT NULL) THEN 'duplicate' WHEN identifier <> first THEN 'repeated' ELSE 'new' END AS outcome FROM b LEFT JOIN f ON b.md5 = f.md5"""
)
def ingest_classify(c):
    docs = c.spark.read.parquet(f"{c.sf_dir}/documents.parquet").select("doc_id", F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("identifier"), F.when(F.col("doc_id") % 11 != 0, F.md5("text")).alias("md5"))
    current = docs.where("doc_id % 2 = 0").select(F.col("identifier").alias("url"), "md5")
    failed = docs.where("doc_id % 35 = 0").select(F.col("identifier").alias("url"))
    return ingest.classify(docs.where("doc_id % 2 = 1 OR doc_id % 10 = 0").select("identifier", "md5"), current, failed)


@query("SELECT content_md5 AS md5, min(original_filename) AS url, array_to_string((list_sort(list_distinct(list(original_filename))))[2:], ',') AS alternates FROM image GROUP BY 1", "image")
def content_alternates(c):
    rows = c["image"].select(F.col("content_md5").alias("md5"), F.col("original_filename").alias("identifier"))
    return ingest.with_alternates(rows).withColumn("alternates", F.array_join("alternates", ","))


@query(
    "SELECT id, CASE WHEN id % 3 = 0 AND id % 6 <> 0 THEN 'A' ELSE audience END AS audience, CASE WHEN id % 3 = 0 THEN 'T' ELSE title END AS title, id % 3 = 0 AS changed FROM image", "image"
)
def update_fields(c):
    rows = c["image"].select("id", "audience", "title")
    new = rows.where("id % 3 = 0").select("id", F.when(F.col("id") % 6 != 0, "A").alias("audience"), F.lit("T").alias("title"))
    return ingest.update_fields(rows, new, "id", ["audience", "title"], nulls_overwrite=False)


@query("SELECT id, CASE WHEN id % 3 = 0 THEN CASE WHEN id % 6 <> 0 THEN 'A' END ELSE audience END AS audience, id % 3 = 0 AS changed FROM image", "image")
def batch_update(c):
    rows = c["image"].select("id", "audience")
    new = rows.where("id % 3 = 0").select("id", F.when(F.col("id") % 6 != 0, "A").alias("audience"))
    return ingest.update_fields(rows, new, "id", ["audience"], nulls_overwrite=True)


@query("SELECT id FROM image WHERE date_deleted IS NULL AND id % 7 <> 0", "image")
def soft_delete_and_purge(c):
    rows = c["image"]
    marked, _ = ingest.soft_delete(rows, rows.where("id % 7 = 0").select("id"), at(NOW), {})
    return ingest.purge(marked).select("id")


@query("SELECT image_identifier, old_url, new_url FROM url_move WHERE old_url LIKE 'http://%'", "url_move")
def url_move(c):
    rows = c["url_move"].where("old_url LIKE 'http://%'")
    new = rows.select("new_url").distinct()
    return catalogue.moved_urls(new, rows, "https://", "http://").select("image_identifier", "old_url", "new_url")


@query(
    "SELECT page_id, CASE WHEN starts_with(url, 'http://') THEN regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1), '[^/]*$', 0) ELSE '' END AS image_id, "
    "regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]*$', 0) AS file_name FROM pages"
)
def url_image_id(c):
    pages = c.spark.read.parquet(f"{c.sf_dir}/pages.parquet")
    return pages.select("page_id", urls.image_id("url", ["http://"]).alias("image_id"), urls.file_name("url").alias("file_name"))


@query(
    "SELECT id, array_to_string(list_slice(string_split(reverse(image_identifier), ''), 1, 4), '/') || '/' || image_identifier AS path, "
    f"'{HOST}/store/' || array_to_string(list_slice(string_split(reverse(image_identifier), ''), 1, 4), '/') || '/' || image_identifier || '/thumbnail' AS url FROM image",
    "image",
)
def storage_path(c):
    return c["image"].select("id", urls.storage_path("image_identifier").alias("path"), urls.rendition_url(HOST, "image_identifier", "thumbnail").alias("url"))


def _tenth(unit: int) -> str:
    return f"regexp_replace(CAST(round(CAST(file_size AS DOUBLE) / {unit}, 1) AS VARCHAR), '\\.0$', '')"


@query(
    f"SELECT id, CASE WHEN file_size <= 0 THEN '0 B' WHEN file_size >= 1048576 THEN {_tenth(1048576)} || ' MB' WHEN file_size >= 1024 THEN {_tenth(1024)} || ' KB' ELSE file_size || ' B' END AS label FROM image", "image"
)
def file_size_label(c):
    return c["image"].select("id", media.human_size("file_size").alias("label"))


@query("SELECT id, strftime(date_uploaded, '%Y-%m-%d') AS day, strftime(date_uploaded, '%Y-%m') AS month, translate(creator, '\"|''&', '') AS creator, coalesce(nullif(audience, ''), 'none') AS audience, CAST(harvestable AS VARCHAR) AS flag FROM image", "image")
def text_functions(c):
    return c["image"].select("id", text.day("date_uploaded").alias("day"), text.month("date_uploaded").alias("month"), text.drop_marks("creator").alias("creator"), text.or_default("audience", "none").alias("audience"), text.flag_text("harvestable").alias("flag"))


@query(
    "SELECT image_identifier, coalesce(title, '') AS title, coalesce(occurrence_id, '') AS \"occurrenceId\", strftime(date_uploaded, '%Y-%m-%d %H:%M:%S') AS \"dateUploaded\", "
    "CASE WHEN mime_type LIKE 'image%' THEN height END AS height, CASE WHEN mime_type LIKE 'image%' THEN width END AS width, CASE WHEN mime_type LIKE 'image%' THEN zoom_levels END AS \"tileZoomLevels\", "
    f"'{HOST}/store/' || p || '/original' AS \"imageUrl\", CASE WHEN mime_type LIKE 'image%' THEN '{HOST}/store/' || p || '/thumbnail' END AS \"thumbUrl\", "
    "coalesce(nullif(data_resource_uid, ''), 'no_dataresource') AS \"dataResourceUid\", coalesce(nullif(license, ''), 'unrecognised_licence') AS licence "
    "FROM (SELECT *, array_to_string(list_slice(string_split(reverse(image_identifier), ''), 1, 4), '/') || '/' || image_identifier AS p FROM image)",
    "image",
)
def image_info(c):
    return exports.image_info(c["image"], HOST)


@query("SELECT id, CASE WHEN audience = '' THEN 'resource ' || data_resource_uid ELSE audience END AS audience FROM image", "image")
def fill_from_resource(c):
    rows = c["image"].select("id", "data_resource_uid", "audience")
    resources = rows.select("data_resource_uid").where("data_resource_uid IS NOT NULL").distinct().withColumn("audience", F.concat(F.lit("resource "), "data_resource_uid"))
    return exports.fill_from_resource(rows, resources, ["audience"]).select("id", "audience")


@query(
    "SELECT p.id AS parent_id, s.id AS sub_id, s.image_identifier AS sub_identifier, greatest(s.id % 7 - 3, 0) AS x, greatest(s.id % 5 - 2, 0) AS y, CAST(row_number() OVER (PARTITION BY p.id ORDER BY s.id) AS INTEGER) AS n, "
    "p.original_filename || '_subimage_' || CAST(row_number() OVER (PARTITION BY p.id ORDER BY s.id) AS VARCHAR) AS name FROM image p JOIN image s ON p.id = s.id // 4 WHERE s.id % 4 <> 0",
    "image",
)
def subimages(c):
    pairs = c["image"].where("id % 4 <> 0").selectExpr("id div 4 AS parent_id", "id AS sub_id", "id % 7 - 3 AS x", "id % 5 - 2 AS y")
    return catalogue.subimages(pairs, c["image"])


@query("SELECT image_identifier FROM image WHERE id % 9 = 0", "image")
def missing_originals(c):
    return catalogue.missing_originals(c["image"].select("id", "image_identifier"), c["image"].where("id % 9 <> 0").select("image_identifier")).select("image_identifier")


@query("SELECT id, height >= 100 AND file_size >= CASE mime_type WHEN 'image/png' THEN 2000 ELSE 500 END AND mime_type LIKE 'image/%' AS passes FROM image", "image")
def stage_filter(c):
    rule = {"minBytes": 500, "minHeight": 100, "minBytesByFormat": {"png": 2000}, "contentTypes": ["image/"]}
    fmt = media.image_format("mime_type", F.lit(""))
    return c["image"].select("id", media.stage_filter(rule, "file_size", "width", "height", "mime_type", fmt, F.lit(False), F.lit(False)).alias("passes"))


@query(
    "SELECT id, strftime(date_uploaded, '%d-%b-%Y %H:%M:%S') AS date_uploaded, array_to_string(alternate_filename, ',') AS alternate_filename, CAST(file_size AS DOUBLE) AS size FROM image", "image"
)
def avro_rows(c):
    return sinks.avro_ready(c["image"].select("id", "date_uploaded", "alternate_filename", F.col("file_size").cast("decimal(18,2)").alias("size")))


@query("SELECT 'UPDATE image SET original_filename = ''' || replace(new_url, '''', '''''') || ''' WHERE image_identifier = ''' || image_identifier || ''';' AS statement FROM url_move", "url_move")
def update_statements(c):
    return sinks.update_statements(c["url_move"])


@query(
    "SELECT id, image_identifier, (SELECT count(*) FROM image WHERE date_deleted IS NULL) AS total FROM image WHERE date_deleted IS NULL ORDER BY date_uploaded DESC, image_identifier LIMIT 25 OFFSET 3", "image"
)
def search_page_with_total(c):
    return search.page_with_total(exports.live(c["image"]), 25, 3).select("id", "image_identifier", "total")


@query(
    "SELECT id, file_size FROM image WHERE id IN (SELECT image_id FROM image_metadata WHERE lower(name) = 'lang' AND lower(value) IN ('en', 'de')) ORDER BY file_size, id DESC LIMIT 40 OFFSET 2", "image", "image_metadata"
)
def metadata_search(c):
    return search.search_by_metadata(c["image"], c["image_metadata"], "LANG", ["EN", "de"], "file_size", "asc", 40, 2).select("id", "file_size")


@query("SELECT id FROM image ORDER BY id DESC LIMIT 20", "image")
def newest_ids(c):
    return search.ordered(c["image"]).limit(20).select("id")


@query("SELECT id FROM image WHERE id = 12", "image")
def by_number(c):
    return search.by_id_or_identifier(c["image"], "12").select("id")


@query("SELECT id FROM image WHERE image_identifier = md5('12')", "image")
def by_identifier(c):
    return search.by_id_or_identifier(c["image"], "c20ad4d76fe97759aa27a0c99bff6710").select("id")


INDEXED = ("imageIdentifier", "format", "fileSize", "harvestable", "fileType")


@query(
    "SELECT field, kind, CAST(filled AS BIGINT) AS filled FROM (SELECT unnest(['imageIdentifier', 'format', 'fileSize', 'harvestable', 'fileType']) AS field, unnest(['string', 'string', 'bigint', 'boolean', 'string']) AS kind, "
    "unnest([count(image_identifier), count(mime_type), count(file_size), count(harvestable), count(mime_type)]) AS filled FROM image WHERE date_deleted IS NULL)",
    "image",
)
def index_fields(c):
    return search.index_fields(exports.export_index(_recognised(c), c["license"]).select(*INDEXED))


@query(
    "SELECT content_md5, n, (SELECT count(*) FROM (SELECT content_md5 FROM image GROUP BY 1 HAVING count(*) > 1)) AS total FROM (SELECT content_md5, count(*) AS n FROM image GROUP BY 1 HAVING count(*) > 1) "
    "ORDER BY n DESC, content_md5 LIMIT 20 OFFSET 1",
    "image",
)
def duplicates_page(c):
    return catalogue.duplicates_page(c["image"], 20, 1)


@query(
    f", u AS (SELECT period, resource_uid, count(*) AS events, count(DISTINCT user_id) AS users FROM {_RECENT} GROUP BY 1, 2 UNION ALL SELECT 'total', resource_uid, count(*), count(DISTINCT user_id) FROM usage_event GROUP BY 2) "
    "SELECT u.*, coalesce(r.name, u.resource_uid) AS name FROM u LEFT JOIN resource r ON r.uid = u.resource_uid",
    "usage_event", "resource",
)
def usage_with_names(c):
    return catalogue.usage_with_names(c["usage_event"], c["resource"], at(NOW))


@query("WITH w AS (SELECT DISTINCT 'https://user:pw@files.example.org/' || CAST(n_nationkey * 40 AS VARCHAR) AS name FROM nation), " "image AS (SELECT 'https://user:pw@files.example.org/' || CAST(doc_id % 500 AS VARCHAR) AS f FROM documents) "
       "SELECT name, count(f) AS n FROM w LEFT JOIN image ON f = name GROUP BY 1")
def requested_names(c):
    names = c.spark.read.parquet(f"{c.sf_dir}/nation.parquet").select(F.concat(F.lit("https://user:pw@files.example.org/"), (F.col("n_nationkey") * 40).cast("string")).alias("name"))
    return catalogue.counted_by_name(c["image"], names)


_KIND = "CASE n_nationkey % 3 WHEN 0 THEN 'fs' WHEN 1 THEN 's3' ELSE 'swift' END"
_PLACES = "(VALUES (1, 'fs', '/data/images', NULL, NULL, NULL, NULL), (2, 's3', NULL, 'r1', 'bucket-a', 'pre', NULL), (3, 's3', NULL, 'r1', 'bucket-b', 'x', NULL))"
_PLACE_NAMES = "id, class, base_path, region, bucket, prefix, container"


def _locations(c: Catalogue) -> DataFrame:
    return c.spark.sql(f"SELECT cast(id AS bigint) AS id, class, base_path, region, bucket, prefix, cast(container AS string) AS container FROM {_PLACES} AS t({_PLACE_NAMES})")


@query(
    f"WITH l AS (SELECT n_nationkey AS id, {_KIND} AS class, n_name AS name FROM nation WHERE n_nationkey % 3 <> 2), k AS (SELECT * FROM (VALUES (0, 'fs'), (2, 's3'), (4, 'swift')) t(part, class)) "
    "SELECT part, CAST(NULL AS BIGINT) AS id, class || ':' AS line FROM k WHERE class IN (SELECT class FROM l) UNION ALL SELECT part + 1, CAST(id AS BIGINT), '  ' || name FROM l JOIN k USING (class)"
)
def configuration_report(c):
    """Storage locations stand for the nations, two kinds of three; the third kind has no header."""
    nations = c.spark.read.parquet(f"{c.sf_dir}/nation.parquet").where("n_nationkey % 3 <> 2")
    named = [F.when(F.expr(_KIND) == kind, F.col("n_name")).alias(column) for kind, column in (("fs", "base_path"), ("s3", "bucket"), ("swift", "container"))]
    return catalogue.configuration_report(nations.select(F.col("n_nationkey").cast("long").alias("id"), F.expr(_KIND).alias("class"), *named))


@query(
    "SELECT id, CASE id % 4 WHEN 0 THEN 'kept' WHEN 1 THEN 'fs-data-images' WHEN 2 THEN 's3-r1-bucket-a-pre' ELSE 's3-r1-bucket-b-x' END AS storage_location_name FROM image", "image"
)
def storage_names(c):
    rows = c["image"].select("id", (F.col("id") % 4).alias("storage_location_id"), F.when(F.col("id") % 4 == 0, "kept").alias("storage_location_name"))
    return ingest.backfill(rows, _locations(c)).select("id", "storage_location_name")


@query("SELECT u.id, u.resource, list(CAST(f.file_no AS VARCHAR) || ' ' || f.status || ' ' || CAST(f.record_count AS VARCHAR) ORDER BY f.file_no, f.status, f.record_count)::VARCHAR AS files FROM batch_upload u LEFT JOIN batch_file f ON f.upload_id = u.id GROUP BY 1, 2", "batch_upload", "batch_file")
def batch_status(c):
    rows = catalogue.batch_status(c["batch_upload"], c["batch_file"])
    listed = F.concat(F.lit("["), F.array_join(F.transform("files", lambda f: F.concat_ws(" ", f["file_no"].cast("string"), f["status"], f["record_count"].cast("string"))), ", "), F.lit("]"))
    return rows.select("id", "resource", F.when(F.col("files").isNull(), "[NULL]").otherwise(listed).alias("files"))


@query(
    ", n AS (SELECT upload_id, count(*) AS n, count(*) FILTER (status = 'COMPLETE') AS done, count(*) FILTER (status = 'LOADING') AS loading, count(*) FILTER (status = 'QUEUED') AS queued FROM batch_file GROUP BY 1) "
    "SELECT u.id AS upload_id, CASE WHEN n IS NULL THEN 'UNPACKING' WHEN done = n THEN 'COMPLETE' WHEN loading > 0 THEN 'LOADING' WHEN queued = n THEN 'WAITING_PROCESSING' ELSE 'PARTIALLY_COMPLETE' END AS state "
    "FROM batch_upload u LEFT JOIN n ON n.upload_id = u.id",
    "batch_upload", "batch_file",
)
def upload_states(c):
    return ingest.upload_states(c["batch_upload"], c["batch_file"])


@query("SELECT upload_id, file_no, CASE status WHEN 'LOADING' THEN 'STOPPED' ELSE status END AS status FROM batch_file", "batch_file")
def after_restart(c):
    return ingest.after_restart(c["batch_file"]).select("upload_id", "file_no", "status")


@query(
    "WITH m AS (SELECT 'a' || CAST(doc_id % 9 AS VARCHAR) AS archive, 'm' || CAST(doc_id AS VARCHAR) AS member, md5(text) AS md5 FROM documents), l AS (SELECT md5 FROM m WHERE archive < 'a4' AND md5 IS NOT NULL) "
    "SELECT arg_min(archive, archive || '/' || member) AS archive, arg_min(member, archive || '/' || member) AS member, md5 FROM m WHERE md5 IS NOT NULL AND md5 NOT IN (SELECT md5 FROM l) GROUP BY md5"
)
def resent_members(c):
    members = c.spark.read.parquet(f"{c.sf_dir}/documents.parquet").where("text IS NOT NULL")
    members = members.select(F.concat(F.lit("a"), (F.col("doc_id") % 9).cast("string")).alias("archive"), F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("member"), F.md5("text").alias("md5"))
    return ingest.new_members(members, members.where("archive < 'a4'"))


@query(
    ", m AS (SELECT content_md5 AS md5, min(original_filename) AS f, max(date_deleted) AS d FROM image WHERE id % 3 <> 0 GROUP BY 1), i AS (SELECT content_md5 AS md5, min(original_filename) AS first, "
    "list_sort(list_distinct(list(original_filename))) AS all_urls FROM image WHERE id % 2 = 0 GROUP BY 1) SELECT md5, coalesce(f, first) AS original_filename, "
    "array_to_string(CASE WHEN f IS NULL THEN list_filter(all_urls, lambda x: x <> first) WHEN first IS NULL THEN [] ELSE list_filter(all_urls, lambda x: x <> f) END, ',') AS alternates, "
    "CASE WHEN f IS NULL THEN 'new' WHEN first IS NULL THEN 'kept' WHEN d IS NULL THEN 'duplicate' ELSE 'restored' END AS outcome FROM m FULL JOIN i USING (md5)",
    "image",
)
def content_merge(c):
    have = c["image"].where("id % 3 <> 0").groupBy(F.col("content_md5").alias("md5")).agg(F.min("original_filename").alias("original_filename"), F.max("date_deleted").alias("date_deleted"))
    have = have.withColumn("alternate_filename", F.lit(None).cast("array<string>"))
    items = c["image"].where("id % 2 = 0").select(F.col("content_md5").alias("md5"), F.col("original_filename").alias("identifier"))
    return ingest.merge_content(have, items).select("md5", "original_filename", F.array_join("alternate_filename", ",").alias("alternates"), "outcome")


@query(
    "SELECT id, 'f_' || CAST(id AS VARCHAR) || '_' || extension AS filename, CAST(id AS VARCHAR) AS number, 'fixed' AS kind, CASE WHEN id % 2 = 0 THEN coalesce(title, '') ELSE '' END AS title, '' AS missing, '' AS odd FROM image", "image"
)
def staged_files(c):
    files = c["image"].select("id", F.concat(F.lit("f_"), F.col("id").cast("string"), F.lit("_"), "extension").alias("filename"))
    data = c["image"].where("id % 2 = 0").select(F.concat(F.lit("f_"), F.col("id").cast("string"), F.lit("_"), "extension").alias("filename"), F.col("title").alias("name of it"))
    wanted = [("number", "regex", r"f_(\d+)_.*"), ("kind", "literal", "fixed"), ("title", "column", "name of it"), ("missing", "column", ""), ("odd", "regex", r"(\d+)")]
    return ingest.staged_rows(files, data, wanted)


@query("SELECT id FROM image WHERE date_uploaded < timestamp '2024-01-31' - to_days(20)", "image")
def stale_staged(c):
    return ingest.stale_staged(c["image"].withColumnRenamed("date_uploaded", "date_staged"), at(NOW), 20).select("id")


@query("SELECT image_identifier FROM image WHERE id % 8 <> 0", "image")
def index_delete(c):
    rows = c["image"].select("id", "image_identifier")
    return ingest.remove(rows, rows.where("id % 8 = 0"), "image_identifier").select("image_identifier")


@query("SELECT image_id, name, source, value FROM image_metadata WHERE image_id NOT IN (SELECT id FROM image WHERE date_deleted IS NOT NULL)", "image", "image_metadata")
def purge_children(c):
    return ingest.purge(c["image"], {"metadata": c["image_metadata"]})[1]["metadata"].select("image_id", "name", "source", "value")


@query("SELECT image_identifier AS \"imageId\", file_size AS filesize, zoom_levels AS \"tileZoomLevels\", 'https://files.example.org/' || CAST(id % 500 AS VARCHAR) AS \"originalFileName\" FROM image WHERE date_deleted IS NULL", "image")
def legacy_hits(c):
    index = exports.export_index(_recognised(c), c["license"])
    return exports.harmonised(exports.legacy_names(exports.searchable(index, ["imageIdentifier", "fileSize", "zoomLevels", "originalfilename", "contentmd5hash", "title"], ("title",))))


@query("SELECT data_resource_uid FROM image WHERE image_identifier = md5('12')", "image")
def one_column(c):
    return exports.one_column(c["image"], "image_identifier", "c20ad4d76fe97759aa27a0c99bff6710", "data_resource_uid")


@query("SELECT url, http_status FROM failed_upload WHERE regexp_matches(url, '/(en|fr)/') ORDER BY date_created, url LIMIT 100", "failed_upload")
def failed_preview(c):
    return catalogue.failed_preview(c["failed_upload"], "/(en|fr)/").select("url", "http_status")


@query(
    f"SELECT url, CASE WHEN date_created >= timestamp '{NOW}' - to_days(12) THEN CASE WHEN http_status % 2 = 0 THEN 'removed' ELSE 'kept' END ELSE 'kept unchecked' END AS action "
    "FROM (SELECT url, min(date_created) AS date_created, max(http_status) AS http_status FROM failed_upload GROUP BY 1)",
    "failed_upload",
)
def failed_recheck(c):
    rows = c["failed_upload"].groupBy("url").agg(F.min("date_created").alias("date_created"), F.max("http_status").alias("http_status"))
    return catalogue.recheck_failed(rows, rows.where("http_status % 2 = 0"), at(NOW), 12).select("url", "action")


@query("SELECT id, NOT harvestable AS harvestable, coalesce(data_resource_uid, 'none') AS data_resource_uid FROM image", "image")
def migrations(c):
    return ingest.filled(ingest.negated(c["image"], "harvestable"), "data_resource_uid", "none").select("id", "harvestable", "data_resource_uid")


@query("SELECT upload_id, file_no, CASE WHEN upload_id = 1 THEN 'QUEUED' ELSE status END AS status FROM batch_file", "batch_file")
def status_update(c):
    return ingest.set_status(c["batch_file"], "upload_id", 1, "QUEUED").select("upload_id", "file_no", "status")


@query("SELECT id, split_part(original_filename, '//', 2) AS rest, 'a b/' || CAST(id AS VARCHAR) AS decoded, id AS parsed FROM image", "image")
def text_parsing(c):
    packed = F.concat(F.lit('{"n": '), F.col("id").cast("string"), F.lit(', "more": 1}'))
    encoded = F.concat(F.lit("a+b%2F"), F.col("id").cast("string"))
    return c["image"].select("id", text.part("original_filename", "//", 2).alias("rest"), text.url_decoded(encoded).alias("decoded"), text.parsed(packed, "n long")["n"].alias("parsed"))


@query("SELECT id, path FROM deep_tag WHERE '/standard/red/widget' LIKE path || '/%' UNION ALL SELECT -1, path FROM (SELECT '/' || lower(r_name) AS path FROM region) WHERE '/asia/japan/tokyo' LIKE path || '/%' UNION ALL SELECT id, path FROM tag WHERE '/asia/japan/tokyo' LIKE path || '/%'", "tag", "deep_tag")
def tag_ancestors(c):
    """Of tags that have all their ancestors, as ``create`` makes them, and of tags that lack some."""
    made = tags.create(c["tag"], c["tag"]).select(F.lit(-1).cast("long").alias("id"), "path")
    every = c["tag"].unionByName(made)
    return tags.ancestors_longest_first(every, "/asia/japan/tokyo").unionByName(tags.ancestors_longest_first(c["deep_tag"], "/standard/red/widget")).select("id", "path")


_USED = "SELECT license AS acronym, 'as image ' || CAST(id AS VARCHAR) AS name, 1000 + id AS id FROM image"


@query(f", used AS ({_USED}) SELECT id, acronym, name FROM license WHERE acronym NOT IN (SELECT acronym FROM used) UNION ALL SELECT max(id), acronym, arg_max(name, id) FROM used GROUP BY acronym", "license", "image")
def licence_upsert(c):
    """The licences that images name, by acronym: the image of the largest id is the last."""
    used = c["image"].select(F.col("license").alias("acronym"), F.concat(F.lit("as image "), F.col("id").cast("string")).alias("name"), (F.col("id") + 1000).alias("id"))
    return merge.upsert(c["license"].select(F.col("id").cast("long").alias("id"), "acronym", "name"), used, "acronym", order="id")


@query(f", used AS ({_USED}) SELECT id, acronym FROM license UNION ALL SELECT min(id), acronym FROM used WHERE acronym NOT IN (SELECT acronym FROM license) GROUP BY acronym", "license", "image")
def licence_insert_missing(c):
    used = c["image"].select(F.col("license").alias("acronym"), (F.col("id") + 1000).alias("id"))
    return merge.insert_missing(c["license"].select(F.col("id").cast("long").alias("id"), "acronym"), used, "acronym", order="id")


@query(
    "SELECT identifier, min(title) AS title FROM (SELECT 'u' || CAST(doc_id // 2 AS VARCHAR) AS identifier, text AS title FROM documents WHERE doc_id % 50 <> 3) GROUP BY 1"
)
def batch_items(c):
    """Items of whole texts, two with each identifier, of which the first by its text stays."""
    docs = c.spark.read.parquet(f"{c.sf_dir}/documents.parquet")
    name = F.when(F.col("doc_id") % 50 == 3, " ").otherwise(F.concat(F.lit("u"), F.expr("doc_id div 2").cast("string")))
    nested = docs.select(F.col("doc_id").cast("string").alias("id"), F.array(F.struct(name.alias("identifier"), F.col("text").alias("title"))).alias("multimediaItems"))
    return ingest.first_per_identifier(ingest.flatten(nested), "title").select("identifier", "title")


@query(f"SELECT CAST(count(*) FILTER (id % 4 = 0) AS BIGINT) AS errors, CAST(count(*) FILTER (id % 4 = 1) AS BIGINT) AS new_images, CAST(count(*) FILTER (id % 4 > 1) AS BIGINT) AS metadata_updates FROM image", "image")
def batch_counters(c):
    names = F.array(*map(F.lit, ("bad", "new", "existing", "duplicate")))
    return ingest.counters(c["image"].select(F.get(names, (F.col("id") % 4).cast("int")).alias("outcome")))


@query("SELECT id, regexp_matches(original_filename, '^https://user') AS known, id % 3 = 0 AS uuid, mime_type LIKE 'image/%' AS allowed FROM image", "image")
def admission(c):
    """A third of the identifiers are written as UUIDs are, with dashes."""
    dashed = F.regexp_replace("image_identifier", "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return c["image"].select("id", urls.starts_with_any("original_filename", ["https://user", "ftp://x"]).alias("known"), urls.is_uuid(F.when(F.col("id") % 3 == 0, dashed).otherwise(F.col("image_identifier"))).alias("uuid"), media.is_class("mime_type", "image").alias("allowed"))


from tidemark import flows, values  # noqa: E402, F401  register their queries
