"""Registered queries that run the scalar functions, and files written and read back, over the catalogue's rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import media, sanitise, text, urls
from tidemark.operators import search
from tidemark.plans.lineage import new_table_path
from tidemark.queries import query
from tidemark.sources import readers, sinks


@query(
    """SELECT id, CASE WHEN w > 0 AND h > 0 THEN CASE WHEN h1 > 300 THEN w1 * 300 // h1 ELSE w1 END END AS thumb_width, CASE WHEN w > 0 AND h > 0 THEN least(h1, 300) END AS thumb_height,
        CASE mime_type WHEN 'image/jpeg' THEN 'jpg' WHEN 'image/png' THEN 'png' WHEN 'audio/mpeg' THEN 'mp3' WHEN 'video/mp4' THEN 'mp4' ELSE 'pdf' END AS ext, CASE mime_type WHEN 'image/jpeg' THEN 'jpeg' WHEN 'image/png' THEN 'png' END AS fmt,
        NOT (zoom_levels > 0 AND id % 10 > zoom_levels) AS tile, CASE WHEN greatest(w, h) > 0 THEN CAST(greatest(ceil(round(log2(greatest(w, h) / 256.0), 9)), 0) AS INTEGER) + 1 END AS levels,
        CASE WHEN w > 0 THEN round(h * CASE id % 3 WHEN 0 THEN 25.4 WHEN 1 THEN 1000.0 ELSE 1.0 END / w, 6) END AS scale
    FROM (SELECT *, width AS w, height AS h, least(width, 300) AS w1, CASE WHEN width > 300 THEN height * 300 // width ELSE height END AS h1 FROM image)""",
    "image",
)
def media_functions(c):
    """Thumbnail bounds, extensions and formats, tiles, and the scale of an image whose height in some unit is known."""
    units = F.get(F.array(F.lit("inches"), F.lit("metres"), F.lit("cubits")), (F.col("id") % 3).cast("int"))
    bounds = media.thumb_bounds("width", "height", 300, 300)
    scale = media.mm_per_pixel("width", F.col("height").cast("double"), units)
    return c["image"].select(
        "id", bounds["width"].alias("thumb_width"), bounds["height"].alias("thumb_height"), media.extension("mime_type").alias("ext"), media.image_format("mime_type", F.lit("")).alias("fmt"),
        media.tile_can_exist("zoom_levels", F.col("id") % 10).alias("tile"), media.zoom_levels("width", "height").alias("levels"), F.round(scale, 6).alias("scale"),
    )


@query(
    """SELECT id, CAST(CASE id % 3 WHEN 0 THEN CAST('0x' || h[1:2] AS INTEGER) WHEN 1 THEN CAST('0x' || h[1] || h[1] AS INTEGER) ELSE id % 256 END AS INTEGER) AS red,
        CAST(CASE id % 3 WHEN 0 THEN CAST('0x' || h[5:6] AS INTEGER) WHEN 1 THEN CAST('0x' || h[3] || h[3] AS INTEGER) ELSE 9 END AS INTEGER) AS blue FROM (SELECT id, image_identifier AS h FROM image)""",
    "image",
)
def colours(c):
    """Colours as six digits, three digits and decimals."""
    h, n = F.col("image_identifier"), (F.col("id") % 256).cast("string")
    shown = F.when(F.col("id") % 3 == 0, F.concat(F.lit("#"), F.substring(h, 1, 6))).when(F.col("id") % 3 == 1, F.substring(h, 1, 3)).otherwise(F.concat(F.lit("rgb("), n, F.lit(", 7,9)")))
    colour = media.parse_colour(shown)
    return c["image"].select("id", colour["red"].alias("red"), colour["blue"].alias("blue"))


@query("SELECT id, date_uploaded AS taken, id % 3 <> 2 AS flag, CASE WHEN id % 2 = 0 THEN 'true' ELSE 'false' END AS shown FROM image", "image")
def form_values(c):
    """Dates as cameras write them, and flags as forms send them."""
    sent = F.get(F.array(F.lit("ON"), F.lit("true"), F.lit("off")), (F.col("id") % 3).cast("int"))
    return c["image"].select("id", text.exif_date(F.date_format("date_uploaded", "yyyy:MM:dd HH:mm:ss")).alias("taken"), text.as_flag(sent).alias("flag"), text.flag_text(F.when(F.col("id") % 2 == 0, True)).alias("shown"))


@query(
    """SELECT id, CASE id % 3 WHEN 0 THEN 'https://****:****@files.example.org/x' WHEN 1 THEN 'https://****@files.example.org/x' ELSE 'https://files.example.org/x' END AS masked, 'https://files.example.org/x' AS bare,
        id % 4 = 1 AS sensitive, id % 4 IN (0, 2) AND id % 5 <> 0 AS allowed FROM image""",
    "image",
)
def url_rules(c):
    """Credentials masked and dropped; query strings that tell a secret, downgrades and user infos, none of which is followed."""
    k = lambda n, *values: F.get(F.array(*map(F.lit, values)), (F.col("id") % n).cast("int"))
    url = F.concat(F.lit("https://"), k(3, "jo:pw@", "jo@", ""), F.lit("files.example.org/x"))
    asked = k(4, "page=1", "Access_Token=2", "", "n=3")
    target = F.concat(k(4, "https://", "https://", "https://", "https://u:p@"), k(2, "other.example.org/y?", "other.example.org/y?"), asked)
    target = F.when(F.col("id") % 5 == 0, F.regexp_replace(target, "^https", "http")).otherwise(target)
    rows = c["image"].select("id", url.alias("url"), target.alias("target"), asked.alias("asked"))
    return rows.select("id", urls.mask_credentials("url").alias("masked"), urls.strip_credentials("url").alias("bare"), urls.has_sensitive_params("asked").alias("sensitive"), urls.may_redirect("url", "target").alias("allowed"))


@query(
    "SELECT id, id % 100 AS a_start, least(id % 100 + 50, n - 1) AS a_end, greatest(n - 20, 0) AS b_start, n - 1 AS b_end, n - greatest(n - 20, 0) AS b_length FROM (SELECT id, file_size + 100 AS n FROM image)", "image"
)
def content_ranges(c):
    """Two ranges of each file: one with both ends, and its last 20 bytes."""
    header = F.concat(F.lit("bytes="), (F.col("id") % 100).cast("string"), F.lit("-"), (F.col("id") % 100 + 50).cast("string"), F.lit(", -20"))
    found = c["image"].select("id", media.byte_ranges(header, F.col("file_size") + 100).alias("r"))
    a, b = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    return found.select("id", a["start"].alias("a_start"), a["end"].alias("a_end"), b["start"].alias("b_start"), b["end"].alias("b_end"), b["length"].alias("b_length"))


@query(
    "SELECT id, CASE WHEN name = 'click' AND value = '' THEN 'never' WHEN name = 'click' AND value <> '' THEN regexp_extract(value, '[0-9]+') || ' times' WHEN name = 'view' AND value <> '' THEN 'seen' ELSE value END AS shown FROM metadata_log", "metadata_log"
)
def metadata_formats(c):
    return c["metadata_log"].select("id", media.first_rule("name", "value", [("Click", r"\w+ (\d+)", "$1 times"), ("view", ".+", "seen"), ("click", ".*", "never")]).alias("shown"))


@query(
    "SELECT id, 'No ' || id || ' &amp; <em>' || coalesce(source, '') || '</em><a href=\"https://x.test/' || id || '\" rel=\"nofollow\">more</a>' AS shown, CASE WHEN length('No ' || id) <= 4 THEN 'No ' || id ELSE 'N...' END AS cut FROM image", "image"
)
def sanitised_html(c):
    n = F.col("id").cast("string")
    page = F.concat(F.lit("<p>No "), n, F.lit(" &amp; <em onclick=x()>"), F.coalesce("source", F.lit("")), F.lit("</em><script>x()</script><a target=_top href='https://x.test/"), n, F.lit("'>more</a>"))
    return c["image"].select("id", sanitise.sanitise(page).alias("shown"), sanitise.sanitise(F.concat(F.lit("<h1>No "), n, F.lit("</h1>")), 4).alias("cut"))


@query(
    "SELECT id, regexp_replace(substr(v, greatest(at - 28, 1), 60), '(?i)(the)', '<b>\\1</b>', 'g') AS fragment FROM (SELECT id, description AS v, instr(lower(description), 'the') AS at FROM image) WHERE at > 0".replace(" at", " place").replace("(at", "(place"),
    "image",
)
def highlighted(c):
    return c["image"].select("id", text.highlight("description", "the").alias("fragment")).where("fragment IS NOT NULL")


# Files written and read back


@query("SELECT CAST(id AS VARCHAR) AS id, image_identifier, nullif(publisher, '') AS publisher, array_to_string(alternate_filename, ',') AS alternate_filename, mime_type FROM image", "image")
def csv_with_header(c):
    """An export in gzip, read by its header: empty fields are null, lists are text."""
    path = new_table_path(c.spark, "csv")
    sinks.write_csv(c["image"].select("id", "image_identifier", "publisher", "alternate_filename", "mime_type"), path, gzip=True)
    return readers.csv_with_header(c.spark, path)


@query("SELECT CAST(id AS VARCHAR) AS id, title, description, rights FROM image WHERE trim(coalesce(title, '')) <> ''", "image")
def csv_by_position(c):
    """Texts with quotes and line breaks, by position; rows without a title are left out."""
    path = new_table_path(c.spark, "csv")
    sinks.write_csv(c["image"].select("id", "title", "description", "rights"), path)
    return readers.csv_rows(c.spark, path, "id string, title string, description string, rights string", required=2, header=True)


@query("SELECT original_filename AS filename, arg_max(image_identifier, id) AS image_identifier FROM image GROUP BY 1", "image")
def last_row_per_file(c):
    rows = c["image"].select(F.col("original_filename").alias("filename"), "image_identifier", "id")
    return readers.last_per_file_name(rows, "id").select("filename", "image_identifier")


@query("SELECT id, title, audience, file_size FROM image", "image")
def json_rows(c):
    """Rows as JSON text, written, and read as a client would."""
    path = new_table_path(c.spark, "json")
    sinks.as_json(c["image"].select("id", "title", "audience", "file_size")).write.text(path)
    return c.spark.read.schema("id long, title string, audience string, file_size long").json(path)


@query("SELECT id, image_identifier AS name, 'f(' || '{\"id\":' || id || '});' AS called FROM image", "image")
def other_renderings(c):
    """JSONP, and XML that is parsed again."""
    rows = c["image"].select("id", F.col("image_identifier").alias("name"))
    parsed = sinks.as_xml(rows).select(F.from_xml("xml", "id long, name string").alias("x")).select("x.*")
    called = sinks.as_jsonp(rows.select("id"), "f").select(F.regexp_replace("json", r"\);?$", ");").alias("called"))
    return parsed.join(called.withColumn("id", F.regexp_extract("called", r"(\d+)", 1).cast("long")), "id")


@query("SELECT path FROM tag UNION ALL SELECT path FROM deep_tag", "tag", "deep_tag")
def tag_lines(c):
    """Tag paths written one a line, with spaces round them and lines between, and read."""
    path = new_table_path(c.spark, "tags")
    every = c["tag"].select("path").unionByName(c["deep_tag"].select("path"))
    every.select(F.concat(F.lit("  "), "path", F.lit(" \n"))).write.text(path)
    return readers.tag_paths(c.spark, path)


@query("SELECT category, count(*) AS n FROM usage_event GROUP BY 1 UNION ALL SELECT 'twice', count(*) FROM usage_event WHERE user_id % 2 = 0", "usage_event")
def audit_log(c):
    """Messages appended in two jobs."""
    path, rows = new_table_path(c.spark, "audit"), c["usage_event"].select("event_id", "category")
    sinks.append_audit(rows, path)
    sinks.append_audit(c["usage_event"].where("user_id % 2 = 0").select("event_id", F.lit("twice").alias("category")), path)
    return c.spark.read.parquet(path).groupBy("category").agg(F.count("*").alias("n"))


@query("SELECT id, image_identifier FROM image WHERE original_filename IN (SELECT 'https://user:pw@files.example.org/' || CAST(n_nationkey * 40 AS VARCHAR) FROM nation)".replace("FROM nation", "FROM nations"), "image", "nations")
def by_file_names(c):
    """Images whose file name is any of a list."""
    names = c["nations"].select(F.concat(F.lit("https://user:pw@files.example.org/"), (F.col("n_nationkey") * 40).cast("string")).alias("name"))
    return search.by_file_names(c["image"], names).select("id", "image_identifier")
