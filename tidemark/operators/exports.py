"""Export views: cleaned catalogue, index, URL mapping and data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import media, text, urls


def live(images: DataFrame) -> DataFrame:
    """Images that are not deleted (FL13)."""
    return images.where(F.col("date_deleted").isNull())


def all_urls() -> Column:
    """Alternate URLs and then the current one (SO2); a null list counts as empty."""
    return F.array_append(F.coalesce("alternate_filename", F.array().cast("array<string>")), F.col("original_filename"))


def with_licence(images: DataFrame, licences: DataFrame, key: str = "recognised_license_id") -> DataFrame:
    """Left join to the licence table (JN1); Spark decides by its size whether to broadcast it."""
    names = licences.select(F.col("id").alias("__licence"), F.col("acronym").alias("recognised_licence"))
    return images.join(names, F.col(key) == F.col("__licence"), "left").drop("__licence")


def export_images(images: DataFrame, licences: DataFrame, base: str) -> DataFrame:
    """The catalogue in Darwin Core terms (PJ1); deleted images are included."""
    lines = {c: text.one_line(c).alias(c) for c in ("creator", "title", "license", "rights", "description")}
    return with_licence(images, licences).select(
        F.col("data_resource_uid").alias("dataResourceUid"),
        F.col("occurrence_id").alias("occurrenceID"),
        text.joined(F.lit(f"{base}/image/proxyImageThumbnailLarge?imageId="), "image_identifier").alias("identifier"),
        *lines.values(),
        text.second("date_taken").alias("created"),
        F.col("mime_type").alias("format"),
        text.one_line("rights_holder").alias("rightsHolder"),
        text.joined(F.lit(f"{base}/image/"), "image_identifier").alias("references"),
        "extension",
        F.col("recognised_licence").alias("recognisedLicense"),
        text.second("date_deleted").alias("dateDeleted"),
        F.col("content_md5").alias("md5hash"),
        F.col("file_size").alias("fileSize"),
        "width",
        "height",
        F.col("zoom_levels").alias("zoomLevels"),
        F.col("image_identifier").alias("imageIdentifier"),
    )


def export_index(images: DataFrame, licences: DataFrame) -> DataFrame:
    """Documents of the search index (PJ2): live images, dates as text, cleaned text; then the facets that the index adds."""
    clean = {c: text.one_line(text.drop_first_marks(c)) for c in ("creator", "title", "description", "rights", "rights_holder", "license")}
    return with_licence(live(images), licences).select(
        F.col("image_identifier").alias("imageIdentifier"),
        F.col("content_md5").alias("contentmd5hash"),
        F.col("content_sha1").alias("contentsha1hash"),
        F.col("mime_type").alias("format"),
        F.col("original_filename").alias("originalfilename"),
        "extension",
        text.day("date_uploaded").alias("dateUploaded"),
        text.day("date_taken").alias("dateTaken"),
        F.col("file_size").alias("fileSize"),
        "height",
        "width",
        F.col("zoom_levels").alias("zoomLevels"),
        F.col("data_resource_uid").alias("dataResourceUid"),
        *(clean[c].alias(c) for c in ("creator", "title", "description", "rights", "license")),
        clean["rights_holder"].alias("rightsHolder"),
        F.col("thumb_height").alias("thumbHeight"),
        F.col("thumb_width").alias("thumbWidth"),
        "harvestable",
        F.col("recognised_licence").alias("recognisedLicence"),
        F.col("occurrence_id").alias("occurrenceID"),
        *("audience", "source", "contributor", "type", "created"),
        F.col("dc_references").alias("references"),
        text.month("date_uploaded").alias("dateUploadedYearMonth"),
        media.size_bucket("height", "width").alias("imageSize"),
        media.file_type("mime_type").alias("fileType"),
    )


def export_mapping(images: DataFrame) -> DataFrame:
    """Each URL of each live image of a data resource, without credentials (PJ3, FL16, JN2)."""
    rows = live(images).where(F.col("data_resource_uid").isNotNull())
    return rows.select("data_resource_uid", F.col("image_identifier").alias("imageID"), F.explode(all_urls()).alias("u")).select(
        "data_resource_uid", "imageID", urls.drop_credentials("u").alias("url")
    )


def export_dataset(images: DataFrame, data_resource_uid: str) -> DataFrame:
    """Live images of one data resource, a row for each URL, control characters removed (PJ4, FL15)."""
    rows = live(images).where(F.col("data_resource_uid") == data_resource_uid).withColumn("u", F.explode(all_urls()))
    plain = {c: c for c in ("audience", "contributor", "created", "creator", "description", "license", "publisher", "source", "title", "type")}
    plain |= {"mime_type": "format", "dc_references": "references", "rights_holder": "rightsHolder"}
    return rows.select(
        F.col("image_identifier").alias("imageID"),
        text.strip_control(urls.drop_credentials("u")).alias("identifier"),
        *(text.strip_control(c).alias(name) for c, name in plain.items()),
    )


def export_dataset_mapping(images: DataFrame, data_resource_uid: str) -> DataFrame:
    """Image and URL of one data resource (PJ5)."""
    return export_mapping(images.where(F.col("data_resource_uid") == data_resource_uid)).select("imageID", "url")


def image_info(images: DataFrame, base: str) -> DataFrame:
    """Info rows (PJ8, PJ9): nulls as empty text, pixel columns only for images."""
    pixels = media.is_class("mime_type", "image")
    return images.select(
        "image_identifier",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("occurrence_id", F.lit("")).alias("occurrenceId"),
        text.second("date_uploaded").alias("dateUploaded"),
        F.when(pixels, F.col("height")).alias("height"),
        F.when(pixels, F.col("width")).alias("width"),
        F.when(pixels, F.col("zoom_levels")).alias("tileZoomLevels"),
        urls.rendition_url(base, "image_identifier", "original").alias("imageUrl"),
        F.when(pixels, urls.rendition_url(base, "image_identifier", "thumbnail")).alias("thumbUrl"),
        text.or_default("data_resource_uid", "no_dataresource").alias("dataResourceUid"),
        text.or_default(F.col("license"), "unrecognised_licence").alias("licence"),
    )


def searchable(images: DataFrame, fields: list[str], deny: tuple[str, ...] = ()) -> DataFrame:
    """The fields that are searched, without those that are denied (PJ7, PJ12)."""
    return images.select(*(f for f in fields if f not in deny))


def one_column(images: DataFrame, key: str, value: object, column: str) -> DataFrame:
    """A single column of the rows with a key (PJ6)."""
    return images.where(F.col(key) == value).select(column)


def legacy_names(hits: DataFrame) -> DataFrame:
    """Names that older clients expect (PJ11)."""
    return hits.withColumnsRenamed({"imageIdentifier": "imageId", "zoomLevels": "tileZoomLevels", "fileSize": "filesize"}).drop("contentmd5hash", "contentsha1hash")


def harmonised(hits: DataFrame) -> DataFrame:
    """Hits with one spelling of the original file name, without credentials (PJ10)."""
    spellings = [c for c in ("originalFileName", "originalfilename", "originalFilename") if c in hits.columns]
    name = urls.strip_credentials(F.coalesce(*map(F.col, spellings))) if spellings else F.lit(None).cast("string")
    return hits.select(*(c for c in hits.columns if c not in spellings), name.alias("originalFileName"))


def fill_from_resource(images: DataFrame, resources: DataFrame, columns: list[str], key: str = "data_resource_uid") -> DataFrame:
    """Blank values are filled from the data resource's metadata (JN18, SC24)."""
    r = resources.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    out = images.join(r, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"__{c}")))
    return out.select(images.columns)
