"""The media catalogue as views over the driver's tables.

The reference relations are not supplied, so each is derived from a table that is. Every
expression is written once, in SQL that Spark and DuckDB read alike; the oracles prepend the
same text. Only dialect differences (timestamps, arrays) have two forms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

HOST = "https://media.example.org"

_HOURS = {"spark": "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id % 8760 as int))", "duckdb": "timestamp '2024-01-01 00:00:00' + to_hours(cast(doc_id % 8760 as integer))"}
_LIST = {"spark": "array({})", "duckdb": "[{}]"}


def _image(dialect: str) -> str:
    alt = _LIST[dialect].format("'https://alt.example.org/a/' || cast(doc_id as varchar(20))") if dialect == "duckdb" else _LIST[dialect].format("'https://alt.example.org/a/' || cast(doc_id as string)")
    text = "varchar" if dialect == "duckdb" else "string"
    return f"""
        SELECT doc_id AS id, md5(cast(doc_id AS {text})) AS image_identifier, md5(text) AS content_md5, sha1(text) AS content_sha1,
            substr(text, 1, 60) AS title, text AS description, substr(text, 61, 40) AS creator,
            CASE WHEN doc_id % 17 = 0 THEN NULL ELSE source END AS data_resource_uid, cast(n_chars AS bigint) AS file_size,
            cast((doc_id * 53) % 4000 AS bigint) AS height, cast((doc_id * 37) % 4000 AS bigint) AS width,
            CASE doc_id % 5 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'audio/mpeg' WHEN 3 THEN 'video/mp4' ELSE 'application/pdf' END AS mime_type,
            {_HOURS[dialect]} AS date_uploaded, CASE WHEN doc_id % 10 = 0 THEN {_HOURS[dialect]} END AS date_deleted,
            CASE lang WHEN 'en' THEN 'CC-BY' WHEN 'fr' THEN 'http://licences.example.org/by-nc/4.0/' WHEN 'de' THEN 'cc by share alike' ELSE 'all rights reserved' END AS license,
            'https://user:pw@files.example.org/' || cast(doc_id % 500 AS {text}) AS original_filename,
            CASE WHEN doc_id % 3 = 0 THEN {alt} END AS alternate_filename,
            doc_id % 4 = 0 AS harvestable, CASE WHEN doc_id % 2 = 0 THEN 'occ-' || cast(doc_id AS {text}) END AS occurrence_id,
            CASE WHEN doc_id % 6 = 0 THEN '' ELSE lang END AS audience, cast(doc_id % 8 AS bigint) AS zoom_levels,
            'loc-' || cast(doc_id % 3 AS {text}) AS storage_location, CASE WHEN doc_id % 4 = 1 THEN 'by' || chr(10) || source END AS contributor,
            cast(1990 + doc_id % 30 AS {text}) AS created, CASE WHEN doc_id % 9 = 0 THEN '' ELSE 'press ' || source END AS publisher,
            'all|' || lang || '|rights' || chr(10) || 'reserved' AS rights, 'holder ' || source AS rights_holder, 'https://refs.example.org/' || cast(doc_id AS {text}) AS dc_references,
            'camera ' || cast(doc_id % 7 AS {text}) AS source, CASE WHEN doc_id % 5 < 2 THEN 'StillImage' END AS type,
            CASE doc_id % 5 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' WHEN 2 THEN 'mp3' WHEN 3 THEN 'mp4' ELSE 'pdf' END AS extension,
            CASE WHEN doc_id % 3 = 1 THEN {_HOURS[dialect]} END AS date_taken, cast(doc_id % 300 AS bigint) AS thumb_height, cast(doc_id % 200 AS bigint) AS thumb_width
        FROM documents"""


#: The licences that are recognised, and other spellings of them.
LICENCES = [
    (1, "CC-BY", "Creative Commons Attribution", "http://licences.example.org/by/4.0/", "http://licences.example.org/by.png"),
    (2, "CC-BY-NC", "Creative Commons Attribution Noncommercial", "http://licences.example.org/by-nc/4.0/", "http://licences.example.org/by-nc.png"),
    (3, "CC-BY-SA", "Creative Commons Attribution Share Alike", "http://licences.example.org/by-sa/4.0/", "http://licences.example.org/by-sa.png"),
]
MAPPINGS = [(3, "cc by share alike"), (2, "by-nc"), (1, "attribution")]


def _values(rows: list[tuple], names: str) -> str:
    body = ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else f"'{v}'" for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({names})"


def relations(dialect: str) -> dict[str, str]:
    """SQL of each catalogue relation in one dialect, in an order in which they can be defined."""
    text = "varchar" if dialect == "duckdb" else "string"
    return {
        "image": _image(dialect),
        "license": _values(LICENCES, "id, acronym, name, url, image_url"),
        "license_mapping": _values(MAPPINGS, "license_id, value"),
        "image_metadata": f"""
            SELECT d.doc_id AS image_id, 'lang' AS name, d.lang AS value, 'SystemDefined' AS source FROM documents d
            UNION ALL SELECT doc_id, 'quality', cast(quality AS {text}), 'UserDefined' FROM labels
            UNION ALL SELECT doc_id, 'Toxic', cast(toxic AS {text}), 'UserDefined' FROM labels""",
        "resource": f"SELECT 'src' || cast(n_nationkey AS {text}) AS uid, 'Resource ' || n_name AS name FROM nation WHERE n_nationkey < 18",
        "tag": "SELECT cast(n_nationkey AS bigint) AS id, '/' || lower(r_name) || '/' || lower(n_name) AS path FROM nation JOIN region ON n_regionkey = r_regionkey",
        "image_tag": "SELECT doc_id AS image_id, doc_id % 25 AS tag_id FROM documents",
        "usage_event": f"SELECT event_id, 'src' || cast(user_id % 20 AS {text}) AS resource_uid, event_type AS category, user_id, ts FROM events",
        "batch_upload": "SELECT o_orderkey AS id, cast(o_custkey % 50 AS bigint) AS resource, o_orderdate AS date_created, o_orderstatus AS code FROM orders",
        "batch_file": """
            SELECT l_orderkey AS upload_id, cast(l_linenumber AS bigint) AS file_no, cast(l_quantity AS bigint) AS record_count,
                CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE cast(floor(l_quantity / 2) AS bigint) END AS new_images,
                CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE cast(floor(l_quantity / 3) AS bigint) END AS metadata_updates,
                CASE WHEN l_returnflag = 'R' THEN cast(1 AS bigint) ELSE cast(0 AS bigint) END AS error_count,
                CASE l_linestatus WHEN 'F' THEN 'COMPLETE' ELSE CASE l_linenumber % 3 WHEN 0 THEN 'LOADING' WHEN 1 THEN 'QUEUED' ELSE 'STOPPED' END END AS status, l_shipdate AS date_completed
            FROM lineitem""",
        "metadata_log": f"""
            SELECT event_id AS id, user_id AS image_id, event_type AS name, CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 11 = 0 THEN NULL ELSE event_type || ' ' || cast(event_id % 1000 AS {text}) END AS value,
                CASE event_id % 5 WHEN 0 THEN 'Embedded' WHEN 1 THEN 'UserDefined' ELSE 'SystemDefined' END AS source FROM events""",
        "batch_log": f"""
            SELECT event_id AS id, CASE WHEN event_id % 97 = 0 THEN NULL ELSE user_id END AS image_id, CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN '' ELSE event_type END AS audience,
                CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'press ' || cast(event_id % 2 AS {text}) END AS publisher FROM events""",
        "url_log": f"""
            SELECT event_id AS seq, CASE WHEN event_id % 89 = 0 THEN '' WHEN event_id % 5 = 0 THEN 'https://alt.example.org/a/' || cast(user_id * 3 AS {text}) WHEN event_id % 31 = 0 THEN 'https://new.example.org/' || cast(event_id AS {text})
                ELSE 'https://user:pw@files.example.org/' || cast(user_id AS {text}) END AS identifier, CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS audience, 'press ' || cast(event_id % 4 AS {text}) AS publisher FROM events""",
        "tool_result": f"""
            SELECT l_orderkey AS id, cast(CASE WHEN l_linenumber <= 3 THEN 0 WHEN l_linenumber <= 6 THEN 1 ELSE 2 END AS bigint) AS stage, cast((l_linenumber - 1) % 3 AS bigint) AS step, l_returnflag <> 'R' AS ok, cast(floor(l_extendedprice) AS bigint) AS bytes,
                l_linenumber % 4 = 0 AS lossy, l_partkey % 19 = 0 AS always, l_partkey % 5 = 0 AS larger, CASE WHEN l_partkey % 7 = 0 THEN 'webp' END AS target_format FROM lineitem""",
        "tool_input": """
            SELECT o_orderkey AS id, cast(floor(o_totalprice / 4) AS bigint) AS bytes, cast(o_orderkey % 4000 AS bigint) AS width, cast(o_custkey % 4000 AS bigint) AS height, CASE WHEN o_orderkey % 5 = 0 THEN 'audio/mpeg' ELSE 'image/png' END AS content_type,
                CASE WHEN o_orderkey % 3 = 0 THEN 'jpeg' ELSE 'png' END AS format, o_orderkey % 2 = 0 AS animated, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 = 1 END AS alpha FROM orders""",
        "job": """
            SELECT o_orderkey AS id, cast(o_custkey AS bigint) AS image_id, CASE WHEN o_orderkey % 3 = 0 THEN 'Thumbnail' ELSE 'TMSTile' END AS kind, cast(o_orderkey % 40000 AS int) AS expected_minutes, o_orderdate AS date_created FROM orders""",
        "nations": "SELECT n_nationkey, n_name FROM nation",
        "partner": f"SELECT s_suppkey AS id, CASE WHEN s_suppkey % 10 = 3 THEN NULL ELSE 'src' || cast(s_nationkey AS {text}) END AS uid, s_name AS name FROM supplier",
        "status_event": """
            SELECT event_id AS id, user_id AS upload, CASE event_id % 9 WHEN 0 THEN 'UNZIPPED' WHEN 1 THEN 'WAITING_PROCESSING' WHEN 2 THEN 'LOADING' WHEN 3 THEN 'PARTIALLY_COMPLETE' WHEN 4 THEN 'COMPLETE'
                WHEN 5 THEN 'CORRUPT_AVRO_FILES' WHEN 6 THEN 'LOADING' WHEN 7 THEN 'no such state' END AS status FROM events""",
        "deep_tag": """
            SELECT min(p_partkey) AS id, path FROM (SELECT p_partkey, '/' || lower(p_type) || CASE WHEN p_partkey % 1000 = 1 THEN '' WHEN p_partkey % 11 = 1 THEN '/' || split_part(p_name, ' ', 1)
                ELSE '/' || split_part(p_name, ' ', 1) || '/' || split_part(p_name, ' ', 2) END AS path FROM part) t GROUP BY path""",
        "failed_upload": f"""
            SELECT url, ts AS date_created, cast(400 + page_id % 120 AS bigint) AS http_status FROM pages
            JOIN events ON event_id = page_id WHERE page_id % 2 = 0""",
        "url_move": f"SELECT page_id, url AS old_url, replace(url, 'http://', 'https://') AS new_url, md5(cast(page_id AS {text})) AS image_identifier FROM pages",
    }


BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels")


class Catalogue:
    """Catalogue relations by name, built when they are asked for; unused base tables are never opened."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        sql = relations("spark")[name]
        bound = {t: self.spark.read.parquet(f"{self.sf_dir}/{t}.parquet") for t in BASE_TABLES if f" {t}" in sql}
        for t in bound:
            sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
        return self.spark.sql(sql, **bound) if bound else self.spark.sql(sql)


def oracle(body: str, *names: str) -> str:
    """DuckDB SQL with the catalogue relations ``names`` defined in front."""
    sql = relations("duckdb")
    defined = [f"{n} AS ({sql[n]})" for n in names]
    if body.lstrip().startswith(","):
        return "WITH " + ", ".join(defined) + body
    if not names:
        return body
    return "WITH " + ", ".join(defined) + " " + body
