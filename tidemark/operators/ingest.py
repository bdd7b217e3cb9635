"""Ingest of record batches: flattening, de-duplication, upsert by URL and by content; retention.

Updates are frames: each function returns the rows as they are afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.operators import merge, search
from tidemark.plans.lineage import cut

#: Fields that a batch may set; a null in the batch overwrites (PJ14, MU6).
FIELDS = ("audience", "contributor", "created", "creator", "description", "license", "publisher", "references", "rights", "rightsHolder", "source", "title", "type")
#: Fields that single updates never touch.
PROTECTED = ("date_taken", "date_uploaded", "id")


def flatten(records: DataFrame) -> DataFrame:
    """Items of nested or flat batch records, absent fields as null, blank identifiers dropped (SC9, AG15)."""
    if "multimediaItems" in records.columns:
        records = records.select(F.col("id").alias("record_id"), F.inline("multimediaItems"))
    have = {c.lower(): c for c in records.columns}
    fields = [F.col(have[f.lower()]).alias(f) if f.lower() in have else F.lit(None).cast("string").alias(f) for f in FIELDS]
    return records.where(F.trim(F.coalesce("identifier", F.lit(""))) != "").select("identifier", *fields)


def first_per_identifier(items: DataFrame, *order: str) -> DataFrame:
    """One row of each identifier, the first by ``order``, else by all columns (ST7, WN3)."""
    n = F.row_number().over(W.partitionBy("identifier").orderBy(*(order or items.columns)))
    return items.withColumn("__n", n).where("__n = 1").drop("__n")


def classify(items: DataFrame, catalogue: DataFrame, failed: DataFrame) -> DataFrame:
    """``identifier, md5, outcome``: bad, existing by URL, unread, duplicate by content, repeated in the batch, or new (MU1, MU2).

    ``items`` has identifier and md5; ``catalogue`` has url and md5. Of new items with equal content, that of
    the smallest URL becomes the image and the others are its alternate URLs. An item without a digest, whose download
    failed, is unread unless its URL is known to be bad or is in the catalogue.
    """
    by_url = catalogue.select(F.col("url").alias("identifier")).distinct().withColumn("by_url", F.lit(True))
    by_md5 = catalogue.select("md5").where(F.col("md5").isNotNull()).distinct().withColumn("by_md5", F.lit(True))
    bad = failed.select(F.col("url").alias("identifier")).distinct().withColumn("bad", F.lit(True))
    first = items.where(F.col("md5").isNotNull()).groupBy("md5").agg(F.min("identifier").alias("first"))
    rows = items.join(bad, "identifier", "left").join(by_url, "identifier", "left").join(by_md5, "md5", "left").join(first, "md5", "left")
    outcome = F.when(F.col("bad"), "bad").when(F.col("by_url"), "existing").when(F.col("md5").isNull(), "unread").when(F.col("by_md5"), "duplicate").when(F.col("identifier") != F.col("first"), "repeated").otherwise("new")
    return rows.select("identifier", "md5", outcome.alias("outcome"))


def resolved(items: DataFrame, images: DataFrame, url: str = "identifier") -> DataFrame:
    """``items`` with ``image_id``: the newest image that has the item's URL as its own or as an alternate; null if none has (MU1, WN1)."""
    found = search.latest_for_url(images, items.select(F.col(url).alias("url"))).select(F.col("url").alias(url), F.col("id").alias("image_id"))
    return items.join(found, url, "left")


def apply_batch(images: DataFrame, items: DataFrame, order: str, fields: list[str], url: str = "identifier", blanks: str = "overwrite") -> tuple[DataFrame, DataFrame]:
    """Images after a batch, and the items whose URL no image has (MU1, MU6).

    An item whose URL is known sets the fields of its image, item after item in their order (``merge.merge_in_order``); the others
    are new, or known by their content, which ``classify`` and ``merge_content`` tell. An item without a URL is left out.
    """
    told = cut(resolved(items.where(F.trim(F.coalesce(url, F.lit(""))) != ""), images, url))
    known = told.where(F.col("image_id").isNotNull()).drop("id").withColumnRenamed("image_id", "id")
    return merge.merge_in_order(images, known, ["id"], order, fields, blanks), told.where(F.col("image_id").isNull()).drop("image_id")


def counters(outcomes: DataFrame) -> DataFrame:
    """Errors, new images and metadata updates of a batch (AG13)."""
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return outcomes.agg(n("bad", "unread").alias("errors"), n("new").alias("new_images"), n("existing", "duplicate", "repeated").alias("metadata_updates"))


def with_alternates(items: DataFrame) -> DataFrame:
    """One row of each content: its first URL, and the others as alternates (MU2, SO4). Items without a digest are left out.

    The URLs of one content are one array, as in the catalogue, repeated ones once.
    """
    grouped = items.where(F.col("md5").isNotNull()).groupBy("md5").agg(F.min("identifier").alias("url"), F.collect_set("identifier").alias("all"))
    return grouped.select("md5", "url", F.sort_array(F.array_except("all", F.array("url"))).alias("alternates"))


def merge_content(images: DataFrame, items: DataFrame, alternates: bool = True) -> DataFrame:
    """``md5, original_filename, alternate_filename, date_deleted, outcome`` after items of known content (MU2).

    An image of the same content is restored, and gets the items' URLs as alternates where these are allowed and new to
    it; content that no image has becomes one, named by its smallest URL. Items without a digest are left out.
    """
    none = F.array().cast("array<string>")
    new = with_alternates(items).select("md5", "url", F.array_prepend("alternates", F.col("url")).alias("urls"), "alternates")
    rows = images.select("md5", "original_filename", F.coalesce("alternate_filename", none).alias("alternate_filename"), "date_deleted", F.lit(True).alias("had"))
    more = F.array_except("urls", F.array_append("alternate_filename", F.col("original_filename"))) if alternates else none
    hit = F.col("urls").isNotNull()
    outcome = F.when(F.col("had").isNull(), "new").when(hit & F.col("date_deleted").isNotNull(), "restored").when(hit, "duplicate").otherwise("kept")
    return rows.join(new, "md5", "full").select(
        "md5",
        F.coalesce("original_filename", "url").alias("original_filename"),
        F.when(F.col("had").isNull(), F.col("alternates")).when(hit, F.concat("alternate_filename", more)).otherwise(F.col("alternate_filename")).alias("alternate_filename"),
        F.when(~hit, F.col("date_deleted")).alias("date_deleted"),
        outcome.alias("outcome"),
    )


def update_fields(current: DataFrame, incoming: DataFrame, key: str, fields: list[str], nulls_overwrite: bool, order: str | None = None) -> DataFrame:
    """``current`` with the fields of matching ``incoming`` rows, and whether a row changed (MU5, MU6, MU19).

    Single updates take values that are set and differ, and skip protected fields; batch updates take nulls too.
    Of incoming rows that repeat a key, the last by ``order`` is taken, without one the largest by its fields; a null key
    matches nothing. ``merge.merge_in_order`` applies repeats one after another.
    """
    fields = [f for f in fields if f in current.columns and (nulls_overwrite or f not in PROTECTED)]
    one = incoming.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(*([order] if order else []), *(F.col(f).alias(f"by_{f}") for f in fields))).alias("__r"))
    new = one.select(key, *(F.col(f"__r.{f}").alias(f"__{f}") for f in fields), F.lit(True).alias("__hit"))
    out, changed = current.join(new, key, "left"), F.lit(False)
    for f in fields:
        n, old = F.col(f"__{f}"), F.col(f)
        take = F.col("__hit").isNotNull() if nulls_overwrite else n.isNotNull() & (n.cast("string") != "")
        changed = changed | (F.coalesce(take, F.lit(False)) & ~old.eqNullSafe(n))
        out = out.withColumn(f"__new_{f}", F.when(take, n).otherwise(old))
    kept = [F.col(f"__new_{c}").alias(c) if c in fields else F.col(c) for c in current.columns]
    return out.select(*kept, changed.alias("changed"))


def remove(current: DataFrame, keys: DataFrame, *names: str) -> DataFrame:
    """Rows without those of some keys, as a document goes from the index (SK9)."""
    return current.join(keys.select(*names).distinct(), list(names), "left_anti")


def soft_delete(images: DataFrame, ids: DataFrame, now: Column, children: dict[str, DataFrame], link: str = "image_id") -> tuple[DataFrame, dict[str, DataFrame]]:
    """Images with a deletion date, and child tables without their rows (MU7)."""
    gone = ids.select(F.col("id")).distinct().withColumn("__gone", F.lit(True))
    marked = images.join(gone, "id", "left").withColumn("date_deleted", F.when(F.col("__gone"), F.coalesce("date_deleted", now)).otherwise(F.col("date_deleted"))).select(images.columns)
    keys = gone.select(F.col("id").alias(link))
    return marked, {name: child.join(keys, link, "left_anti") for name, child in children.items()}


def purge(images: DataFrame, children: dict[str, DataFrame] | None = None, link: str = "image_id") -> DataFrame | tuple[DataFrame, dict[str, DataFrame]]:
    """Images without the soft-deleted ones (MU8, FL14), and child tables without their rows if there are any."""
    left = images.where(F.col("date_deleted").isNull())
    if children is None:
        return left
    gone = images.where(F.col("date_deleted").isNotNull()).select(F.col("id").alias(link))
    return left, {name: child.join(gone, link, "left_anti") for name, child in children.items()}


def retained(uploads: DataFrame, files: DataFrame, now: Column, days: int) -> tuple[DataFrame, DataFrame]:
    """Uploads and files that stay: those complete for more than ``days`` go, and uploads left without files (MU12, FL25)."""
    cut = F.timestamp_add("DAY", F.lit(-days), now)
    stay = files.where(~((F.col("status") == "COMPLETE") & (F.col("date_completed") < cut)) | F.col("date_completed").isNull())
    return uploads.join(stay.select(F.col("upload_id").alias("id")), "id", "left_semi"), stay


def stale_staged(files: DataFrame, now: Column, days: int) -> DataFrame:
    """Staged files that nobody used for more than ``days`` (MU12)."""
    return files.where(F.col("date_staged") < F.timestamp_add("DAY", F.lit(-days), now))


def new_members(members: DataFrame, ledger: DataFrame) -> DataFrame:
    """Archive members whose digest the ledger doesn't have, one of each digest, so that sending them again does nothing (ST8, SC10)."""
    fresh = members.join(ledger.select("md5").distinct(), "md5", "left_anti")
    return fresh.groupBy("md5").agg(F.min(F.struct("archive", "member")).alias("m")).select("m.archive", "m.member", "md5")


def upload_states(uploads: DataFrame, files: DataFrame) -> DataFrame:
    """``upload_id, state`` from the files' (ST10): unpacked uploads wait until one file has been loaded or stopped, and are complete when all have been loaded."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    counts = files.groupBy("upload_id").agg(F.count("*").alias("n"), n("COMPLETE").alias("done"), n("LOADING").alias("loading"), n("QUEUED").alias("queued"), n("CORRUPT_AVRO_FILES").alias("corrupt"))
    state = (
        F.when(F.col("n").isNull(), "UNPACKING")
        .when(F.col("corrupt") > 0, "CORRUPT_AVRO_FILES")
        .when(F.col("done") == F.col("n"), "COMPLETE")
        .when(F.col("loading") > 0, "LOADING")
        .when(F.col("queued") == F.col("n"), "WAITING_PROCESSING")
        .otherwise("PARTIALLY_COMPLETE")
    )
    return uploads.select(F.col("id").alias("upload_id")).join(counts, "upload_id", "left").select("upload_id", state.alias("state"))


def after_restart(files: DataFrame) -> DataFrame:
    """Files as they are after a restart: what was being loaded is stopped (ST10)."""
    return files.withColumn("status", F.when(F.col("status") == "LOADING", "STOPPED").otherwise(F.col("status")))


def import_field(kind: str, value: str, file_name: str = "filename") -> Column:
    """The value of an import field (PJ18): a literal, or the first group of a pattern that the whole file name matches, else empty."""
    if kind == "literal":
        return F.lit(value)
    whole = f"^(?:{value})$"
    return F.when(F.col(file_name).rlike(whole), F.coalesce(F.regexp_extract(file_name, whole, 1), F.lit(""))).otherwise("")


def staged_rows(files: DataFrame, data: DataFrame, definitions: list[tuple[str, str, str]]) -> DataFrame:
    """Staged files with a column for each definition ``(name, kind, format)`` (PJ17, JN20).

    A ``column`` definition takes the format's column (the definition's own, if blank) of the data file's row of the same file name.
    """
    wide = files.join(data.select("filename", *(F.col(c).alias(f"__{c}") for c in data.columns if c != "filename")), "filename", "left")
    value = {
        "literal": lambda name, fmt: F.lit(fmt),
        "regex": lambda name, fmt: import_field("regex", fmt) if fmt else F.col("filename"),
        "column": lambda name, fmt: F.coalesce(F.col(f"__{fmt or name}"), F.lit("")) if (fmt or name) in data.columns else F.lit(""),
    }
    return wide.select(*files.columns, *(value[kind](name, fmt).alias(name) for name, kind, fmt in definitions))


def negated(rows: DataFrame, column: str) -> DataFrame:
    """A boolean column turned round, as a migration does (MU15)."""
    return rows.withColumn(column, ~F.col(column))


def filled(rows: DataFrame, column: str, value: object) -> DataFrame:
    """A constant in a column where it is null (MU15)."""
    return rows.withColumn(column, F.coalesce(F.col(column), F.lit(value)))


def overdue(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs older than their own expected duration in minutes (FL25, ST4)."""
    return jobs.where(F.timestamp_add("MINUTE", F.col("expected_minutes").cast("int"), F.col("date_created")) < now)


def requeue_overdue(jobs: DataFrame, now: Column, kinds: tuple[str, ...] = ("TMSTile",)) -> tuple[DataFrame, DataFrame]:
    """Jobs that are left, and what goes back to the queue: overdue jobs go, and their images are queued again if the job is of one of ``kinds`` (ST4)."""
    late = F.coalesce(F.timestamp_add("MINUTE", F.col("expected_minutes").cast("int"), F.col("date_created")) < now, F.lit(False))
    return jobs.where(~late), jobs.where(late & F.col("kind").isin(*kinds)).select("image_id", "kind").distinct()


def set_status(rows: DataFrame, key: str, value: object, status: str) -> DataFrame:
    """A status set where it differs (MU11)."""
    return rows.withColumn("status", F.when((F.col(key) == value) & (F.col("status") != status), status).otherwise(F.col("status")))


def backfill(images: DataFrame, locations: DataFrame) -> DataFrame:
    """Storage names from the locations table where they are missing (JN13, PJ19)."""
    kind = F.when(F.col("class") == "fs", F.concat(F.lit("fs"), F.replace("base_path", F.lit("/"), F.lit("-"))))
    kind = kind.when(F.col("class") == "s3", F.concat_ws("-", F.lit("s3"), "region", "bucket", "prefix")).otherwise(F.concat(F.lit("swift-"), F.col("container")))
    names = locations.select(F.col("id").alias("storage_location_id"), kind.alias("__name"))
    return images.join(names, "storage_location_id", "left").withColumn("storage_location_name", F.coalesce("storage_location_name", "__name")).drop("__name")
