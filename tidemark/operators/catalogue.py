"""Licence matching, duplicates, statistics, metadata, usage and batch reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions import text
from tidemark.plans.ordered import numbered

METADATA_MAX = 8000
#: Most columns of the harvest table, and the sources whose items it shows.
HARVEST_MAX, HARVESTED = 2000, ("SystemDefined", "UserDefined")
PERIODS = (("last 30 days", 30), ("last 90 days", 90), ("last 365 days", 365))


def with_matched_licence(images: DataFrame, licences: DataFrame, mappings: DataFrame) -> DataFrame:
    """Images with ``recognised_license_id``: by acronym, name, url or image url, else by mapping, else null (JN10).

    The four alternatives are exploded into one key column, so the joins with the small tables are equalities.
    """
    keys = licences.select("id", F.explode(F.array("acronym", "name", "url", "image_url")).alias("license")).where(F.col("license").isNotNull())
    keys = keys.groupBy("license").agg(F.min("id").alias("__direct"))
    mapped = mappings.groupBy(F.col("value").alias("license")).agg(F.min("license_id").alias("__mapped"))
    rows = images.join(keys, "license", "left").join(mapped, "license", "left")
    return rows.withColumn("recognised_license_id", F.coalesce("__direct", "__mapped")).drop("__direct", "__mapped")


def match_licence(images: DataFrame, licences: DataFrame, mappings: DataFrame) -> DataFrame:
    """``id, licence_id`` of each image (JN10)."""
    return with_matched_licence(images, licences, mappings).select("id", F.col("recognised_license_id").alias("licence_id"))


def rematch_licence(images: DataFrame, licences: DataFrame, mappings: DataFrame, current: str = "recognised_license_id") -> DataFrame:
    """``id, licence_id`` after a bulk re-match (JN11): mapping, then url, name, acronym; the last wins; nothing is cleared."""
    keyed = mappings.select(F.col("value").alias("license"), F.col("license_id"), F.lit(0).alias("p"))
    for p, c in enumerate(("url", "name", "acronym"), 1):
        keyed = keyed.unionByName(licences.select(F.col(c).alias("license"), F.col("id").alias("license_id"), F.lit(p).alias("p")))
    best = keyed.groupBy("license").agg(F.max_by("license_id", F.struct("p", "license_id")).alias("new"))
    return images.select("id", "license", current).join(best, "license", "left").select("id", F.coalesce("new", current).alias("licence_id"))


def duplicates(images: DataFrame) -> DataFrame:
    """Content hashes that occur more than once, how often, and the image of smallest id (AG5, JN8, WN2)."""
    groups = images.groupBy("content_md5").agg(F.count("*").alias("n"), F.min_by("image_identifier", "id").alias("exemplar"))
    return groups.where(F.col("n") > 1)


def duplicates_page(images: DataFrame, size: int = 50, offset: int = 0) -> DataFrame:
    """A page of the groups of equal content, the largest first, with how many groups there are (AG5); null content is a group."""
    groups = images.groupBy("content_md5").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    total = groups.agg(F.count("*").alias("t")).scalar()
    return groups.orderBy(F.desc("n"), "content_md5").offset(offset).limit(size).withColumn("total", total)


def counted_by_name(images: DataFrame, names: DataFrame) -> DataFrame:
    """For each requested file name, how many images have it, 0 for a missing one (AG21)."""
    have = images.groupBy(F.col("original_filename").alias("name")).agg(F.count("*").alias("n"))
    return names.select("name").distinct().join(have, "name", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def configuration_report(locations: DataFrame) -> DataFrame:
    """Lines of text: a header for each kind of location that exists, and a line for each location (AG19, SO1)."""
    lines = []
    for k, (kind, column) in enumerate((("fs", "base_path"), ("s3", "bucket"), ("swift", "container"))):
        rows = locations.where(F.col("class") == kind)
        header = rows.limit(1).select(F.lit(2 * k).alias("part"), F.lit(None).cast("long").alias("id"), F.lit(f"{kind}:").alias("line"))
        lines += [header, rows.select(F.lit(2 * k + 1).alias("part"), "id", F.concat(F.lit("  "), column).alias("line"))]
    out = lines[0]
    for more in lines[1:]:
        out = out.unionByName(more)
    return out


def repository_stats(images: DataFrame, licences: DataFrame) -> DataFrame:
    """Counts of images, deleted ones, those with a licence text, and licences (AG6, AG18)."""
    return images.agg(
        F.count("*").alias("images"), F.count_if(F.col("date_deleted").isNotNull()).alias("deleted"), F.count_if(F.col("license").isNotNull()).alias("licensed"), F.sum("file_size").alias("bytes")
    ).withColumn("licences", licences.agg(F.count("*").alias("n")).scalar())


def counts_by(df: DataFrame, key: str) -> DataFrame:
    """Rows of each value of an attribute (AG16, AG22)."""
    return df.groupBy(key).agg(F.count("*").alias("n"))


def batch_rollup(uploads: DataFrame, files: DataFrame) -> DataFrame:
    """Sums over the files of each upload, null as 0, and counts by status (AG7, AG13, AG14, AG23, JN15)."""
    zero = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    status = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    rolled = files.groupBy("upload_id").agg(
        F.count("*").alias("files"),
        *map(zero, ("record_count", "new_images", "metadata_updates", "error_count")),
        *map(status, ("COMPLETE", "LOADING", "QUEUED", "STOPPED")),
        F.bool_and(F.col("status") == "COMPLETE").alias("all_complete"),
        F.bool_and(F.coalesce("record_count", F.lit(0)) == 0).alias("no_records"),
    )
    return uploads.select(F.col("id").alias("upload_id"), "resource").join(rolled, "upload_id")


def files_in_order(files: DataFrame) -> DataFrame:
    """Files that are not complete, those being loaded last (SL12, FL24)."""
    return files.where(F.col("status") != "COMPLETE").orderBy(F.when(F.col("status") == "LOADING", 1).otherwise(0), "upload_id", "file_no")


def batch_status(uploads: DataFrame, files: DataFrame) -> DataFrame:
    """Uploads with their files nested (PJ13)."""
    nested = files.groupBy("upload_id").agg(F.sort_array(F.collect_list(F.struct("file_no", "status", "record_count"))).alias("files"))
    return uploads.join(nested, F.col("id") == F.col("upload_id"), "left").drop("upload_id")


def oldest_queued(files: DataFrame, status: str = "QUEUED") -> DataFrame:
    """The next file to load (SL10)."""
    return files.where(F.col("status") == status).orderBy("date_completed", "upload_id", "file_no").limit(1)


def metadata_keys(metadata: DataFrame, source: str | None = None) -> DataFrame:
    """Distinct names, sorted without regard to case (AG11, SL14)."""
    rows = metadata if source is None else metadata.where(F.col("source") == source)
    return rows.select("name").distinct().orderBy(F.lower("name"), "name")


def metadata_pivot(images: DataFrame, metadata: DataFrame, names: list[str]) -> DataFrame:
    """Harvestable images with a column for each of some metadata names (JN7); blanks are skipped, the largest value is taken.

    Where items have an order, ``harvest`` finds the names and takes the last values.
    """
    rows = metadata.where(F.trim("value") != "")
    wide = rows.groupBy("image_id").agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names))
    return images.where("harvestable").select("id", "image_identifier").join(wide, F.col("id") == F.col("image_id"), "left").drop("image_id")


def harvestable_items(images: DataFrame, metadata: DataFrame) -> DataFrame:
    """Metadata items with a value, of harvestable images, that the system or a user has defined."""
    rows = metadata.where(F.col("source").isin(*HARVESTED) & (F.coalesce("value", F.lit("")) != ""))
    return rows.join(images.where("harvestable").select(F.col("id").alias("image_id")), "image_id", "left_semi")


def harvest_names(images: DataFrame, metadata: DataFrame, order: str) -> DataFrame:
    """``name, place``: the columns of the harvest table, in the order in which they are first met, image by image and item by item (AG10)."""
    first = harvestable_items(images, metadata).groupBy("name").agg(F.min(F.struct("image_id", order)).alias("first"))
    return first.select("name", F.row_number().over(W.orderBy("first", "name")).alias("place"))  # a row a name


def harvest(images: DataFrame, metadata: DataFrame, order: str, url: Column, most: int = HARVEST_MAX) -> DataFrame:
    """``imageUrl, occurrenceId`` of each harvestable image, and a column for each name that its metadata have (AG10, SK13).

    Names come from the data, in the order of ``harvest_names``; of the values of one name the last by ``order`` is taken,
    an image without one has an empty text. More than ``most`` names are an error, since each is a column.
    """
    names = [r.name for r in harvest_names(images, metadata, order).orderBy("place").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"the metadata have more than {most} names, each of which would be a column")
    fixed = images.where("harvestable").select("id", url.alias("imageUrl"), F.col("image_identifier").alias("occurrenceId"))
    if not names:
        return fixed.drop("id")
    wide = harvestable_items(images, metadata).groupBy(F.col("image_id").alias("id")).pivot("name", names).agg(F.max_by("value", order))
    wide = wide.toDF("id", *(f"__{k}" for k in range(len(names))))
    return fixed.join(wide, "id", "left").select("imageUrl", "occurrenceId", *(F.coalesce(f"__{k}", F.lit("")).alias(n) for k, n in enumerate(names)))


def metadata_values(metadata: DataFrame, images: DataFrame, key: str, source: str) -> DataFrame:
    """A metadata value of each of some images (JN4)."""
    rows = metadata.where((F.lower("name") == key.lower()) & (F.col("source") == source))
    return rows.join(images.select(F.col("id").alias("image_id")), "image_id", "left_semi").select("image_id", "value")


def upsert_metadata(current: DataFrame, incoming: DataFrame, order: str | None = None) -> DataFrame:
    """Items by (image, name, source): new values replace old ones; blank or overlong new values are skipped (MU3, FN20).

    A null in a key equals a null. Of several new values of one key the last by ``order`` is taken, without one the largest;
    items that repeat a key become one.
    """
    at = F.struct(F.col(order) if order else F.lit(0), F.col("new"))
    new = incoming.select("image_id", "name", "source", *([order] if order else []), text.sanitise_value("value").alias("new")).where((F.col("new") != "") & (F.length("new") <= METADATA_MAX))
    new = new.groupBy("image_id", "name", "source").agg(F.max_by("new", at).alias("new"))
    both = current.select("image_id", "name", "source", F.col("value").alias("old"), F.lit(None).cast("string").alias("new")).unionByName(new.withColumn("old", F.lit(None).cast("string")))
    return both.groupBy("image_id", "name", "source").agg(F.coalesce(F.max("new"), F.max("old")).alias("value"))


def delete_metadata(current: DataFrame, keys: DataFrame) -> DataFrame:
    """What is left without the items of some keys (MU4)."""
    return current.join(keys.select("image_id", "name", "source").distinct(), ["image_id", "name", "source"], "left_anti")


def usage_by_category(events: DataFrame, resource: str, now: Column) -> DataFrame:
    """Events and users of a resource by category in each period (AG8), each period with its own window."""
    return _in_periods(events.where(F.col("resource_uid") == resource), now).groupBy("period", "category").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"))


def usage_by_resource(events: DataFrame, now: Column) -> DataFrame:
    """Events and users of each resource in each period (AG9)."""
    return _in_periods(events, now).groupBy("period", "resource_uid").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"))


def usage_with_names(events: DataFrame, resources: DataFrame, now: Column) -> DataFrame:
    """Events and users of each resource in each period and in all, with the resource's name, or its uid where it has none (AG9, JN19, SL15)."""
    ever = events.groupBy("resource_uid").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users")).withColumn("period", F.lit("total"))
    rows = usage_by_resource(events, now).unionByName(ever)
    names = resources.select(F.col("uid").alias("resource_uid"), "name")
    return rows.join(names, "resource_uid", "left").withColumn("name", F.coalesce("name", "resource_uid")).orderBy("name", "period")


def _in_periods(events: DataFrame, now: Column) -> DataFrame:
    inside = F.array(*(F.when(F.col("ts") >= F.timestamp_add("DAY", F.lit(-days), now), F.lit(name)) for name, days in PERIODS))
    longest = max(days for _, days in PERIODS)
    recent = events.where((F.col("ts") >= F.timestamp_add("DAY", F.lit(-longest), now)) & (F.col("ts") <= now))
    return recent.withColumn("period", F.explode(F.filter(inside, lambda p: p.isNotNull())))


def failed_matching(failed: DataFrame, pattern: str) -> DataFrame:
    """Failed URLs that contain a match (FL19); Spark rejects a malformed pattern when it plans the query."""
    return failed.where(F.col("url").rlike(pattern))


def failed_preview(failed: DataFrame, pattern: str, most: int = 100) -> DataFrame:
    """The first of the failed URLs that contain a match, as they are shown before they are cleared (SL13)."""
    return failed_matching(failed, pattern).orderBy("date_created", "url").limit(most)


def recheck_failed(failed: DataFrame, reachable: DataFrame, now: Column, max_age: int) -> DataFrame:
    """Failed URLs with what becomes of them (ST5): those of the last ``max_age`` days are checked, and go where they can be reached."""
    found = reachable.select("url").distinct().withColumn("__found", F.lit(True))
    due = F.coalesce(F.col("date_created") >= F.timestamp_add("DAY", F.lit(-max_age), now), F.lit(False))
    action = F.when(~due, "kept unchecked").when(F.col("__found"), "removed").otherwise("kept")
    return failed.join(found, "url", "left").withColumn("action", action).drop("__found")


def recheck_plan(failed: DataFrame, now: Column, max_age: int, last_check: Column | None = None, interval: int = 1, forced: bool = False, wave: int = 10) -> DataFrame:
    """Failed URLs that are due for a check, with their ``place`` from the oldest on, and the ``wave`` that they go in (ST5).

    Nothing is due within ``interval`` days of the last check, unless it is forced; URLs that failed more than ``max_age``
    days ago are never due. Requests go in waves of so many, with a pause after each.
    """
    since = F.timestamp_add("DAY", F.lit(-max_age), now)
    open_gate = F.lit(True) if forced or last_check is None else F.coalesce(F.timestamp_add("DAY", F.lit(interval), last_check) <= now, F.lit(True))
    due = numbered(failed.where(open_gate & (F.col("date_created") >= since)), "date_created", "url")
    return due.withColumn("wave", F.floor((F.col("place") - 1) / wave))


def recheck_counts(checked: DataFrame) -> DataFrame:
    """``checked, removed, errors`` of a check, from what ``recheck_failed`` says of each URL and whether the request itself failed."""
    done = F.col("action") != "kept unchecked"
    return checked.agg(F.count_if(done).alias("checked"), F.count_if(F.col("action") == "removed").alias("removed"), F.count_if(done & F.col("error")).alias("errors"))


def known_failed(urls: DataFrame, failed: DataFrame) -> DataFrame:
    """URLs that failed before (FL26)."""
    return urls.join(failed.select("url"), "url", "left_semi")


def missing_originals(images: DataFrame, files: DataFrame) -> DataFrame:
    """Images without a stored original (JN9, SC7)."""
    return images.join(files.select("image_identifier"), "image_identifier", "left_anti")


def moved_urls(new: DataFrame, old: DataFrame, new_prefix: str, old_prefix: str) -> DataFrame:
    """New URLs matched to old ones by what follows their prefixes (JN12)."""
    rest = lambda c, p: F.when(F.col(c).startswith(p), F.substring(F.col(c), len(p) + 1, 1 << 30))
    a = new.select("new_url", rest("new_url", new_prefix).alias("rest")).where(F.col("rest").isNotNull())
    b = old.select("old_url", "image_identifier", rest("old_url", old_prefix).alias("rest")).where(F.col("rest").isNotNull())
    return a.join(b, "rest").select("image_identifier", "old_url", "new_url")


def subimages(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """Subimages with their parents' names and their places among siblings (JN16, WN5, FN38, FN39)."""
    parent = images.select(F.col("id").alias("parent_id"), F.col("original_filename").alias("parent_name"))
    sub = images.select(F.col("id").alias("sub_id"), F.col("image_identifier").alias("sub_identifier"))
    n = F.row_number().over(W.partitionBy("parent_id").orderBy("sub_id"))
    clamp = lambda c: F.greatest(F.col(c), F.lit(0)).alias(c)
    rows = pairs.join(parent, "parent_id").join(sub, "sub_id").withColumn("n", n)
    return rows.select("parent_id", "sub_id", "sub_identifier", clamp("x"), clamp("y"), "n", F.concat("parent_name", F.lit("_subimage_"), F.col("n").cast("string")).alias("name"))
