"""File sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.sources import avro, zips


def write_csv(df: DataFrame, path: str, sep: str = ",", escape: str = '"', gzip: bool = False) -> None:
    """CSV with a header and every field quoted (SK1 to SK3, SK11, SK16, SK17); arrays become text."""
    out = df.select(*(F.array_join(f.name, ",").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema))
    w = out.write.mode("overwrite").option("header", True).option("quoteAll", True).option("sep", sep).option("escape", escape)
    w = w.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    (w.option("compression", "gzip") if gzip else w).csv(path)


def avro_ready(df: DataFrame) -> DataFrame:
    """Columns as Avro rows carry them (SK5): dates and timestamps as text, decimals as doubles, arrays as text, nulls kept."""

    def ready(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "dd-MMM-yyyy HH:mm:ss")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "dd-MMM-yyyy")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, ",")
        return c.alias(f.name)

    return df.select(*map(ready, df.schema))


def write_avro(df: DataFrame, path: str, codec: str = "deflate") -> None:
    """Avro rows as containers (SK4)."""
    avro.write(avro_ready(df), path, mode="overwrite", codec=codec)


def download(df: DataFrame, path: str) -> None:
    """Search results: imageURL first, the other columns by name, nulls as empty (SK6)."""
    names = ["imageURL"] * ("imageURL" in df.columns) + sorted(c for c in df.columns if c != "imageURL")
    write_csv(df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in names)), path)


def download_zip(df: DataFrame, path: str, member: str = "images.csv") -> None:
    """Search results as one CSV in a zip archive (SK6), deflated in tasks; the driver copies the finished bytes, a block at a time."""
    parts = f"{path}.parts"
    zips.join(parts, zips.write_zip(df, parts, member), path)
    fs, root = avro._filesystem(parts)
    fs.delete_dir(root)


def as_jsonp(df: DataFrame, callback: str) -> DataFrame:
    """JSON in a call of the client's function (SK12)."""
    return as_json(df).select(F.concat(F.lit(f"{callback}("), "json", F.lit(")")).alias("json"))


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text a row (SK12)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def as_xml(df: DataFrame) -> DataFrame:
    return df.select(F.to_xml(F.struct(*df.columns)).alias("xml"))


def write_index(df: DataFrame, path: str) -> None:
    """The whole index anew (SK8, SK10)."""
    df.write.mode("overwrite").parquet(path)


def append_audit(df: DataFrame, path: str) -> None:
    """Audit messages (SK15)."""
    df.write.mode("append").parquet(path)


def update_statements(moved: DataFrame) -> DataFrame:
    """SQL text for moved URLs (SK19); quotes are doubled."""
    q = lambda c: F.concat(F.lit("'"), F.replace(F.col(c), F.lit("'"), F.lit("''")), F.lit("'"))
    return moved.select(F.concat(F.lit("UPDATE image SET original_filename = "), q("new_url"), F.lit(" WHERE image_identifier = "), q("image_identifier"), F.lit(";")).alias("statement"))


def shell_lines(rows: DataFrame, commands: list[Column], order: str) -> DataFrame:
    """Several lines of text for each row, in order (SK20)."""
    return rows.select(F.col(order).alias("n"), F.posexplode(F.array(*commands)).alias("k", "line")).orderBy("n", "k").select("line")
