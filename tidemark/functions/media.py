"""Media properties: sizes, types, bounds, colours, ranges and stage filters."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.functions.text import ColumnLike, col

#: The extension of a MIME type, and the reverse.
EXTENSIONS = {
    "image/jpeg": "jpg",
    "image/png": "png",
    "image/gif": "gif",
    "image/tiff": "tif",
    "image/webp": "webp",
    "image/bmp": "bmp",
    "audio/mpeg": "mp3",
    "audio/wav": "wav",
    "video/mp4": "mp4",
    "application/pdf": "pdf",
}
MM_PER_UNIT = {"mm": 1.0, "inches": 25.4, "feet": 304.8, "metres": 1000.0}


def size_bucket(height: ColumnLike, width: ColumnLike) -> Column:
    """Pixels as a facet (FN9)."""
    n = col(height).cast("long") * col(width).cast("long")
    text = F.concat(F.floor(n / 1_000_000).cast("string"), F.lit("m"))
    return F.when(n < 100, "less than 100").when(n < 1_000, "less than 1k").when(n < 10_000, "less than 10k").when(n < 100_000, "less than 100k").when(n < 1_000_000, "less than 1m").otherwise(text)


def file_type(mime: ColumnLike) -> Column:
    """image, sound, video or document by MIME prefix; null without a type (FN10)."""
    m = F.lower(col(mime))
    return F.when(m.startswith("image"), "image").when(m.startswith("audio"), "sound").when(m.startswith("video"), "video").when(m.isNotNull(), "document")


def is_class(mime: ColumnLike, prefix: str) -> Column:
    return F.coalesce(F.lower(col(mime)).startswith(prefix), F.lit(False))


def extension(mime: ColumnLike, file: ColumnLike | None = None, default: str = "jpg") -> Column:
    """By MIME type, else by file name, else the default (FN30)."""
    known = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    by_name = F.nullif(F.lower(F.regexp_extract(col(file), r"\.(\w+)$", 1)), F.lit("")) if file is not None else F.lit(None).cast("string")
    return F.coalesce(F.try_element_at(known, F.lower(col(mime))), by_name, F.lit(default))


def image_format(mime: ColumnLike, file: ColumnLike) -> Column:
    """jpeg, png, gif, tiff, webp by MIME type or file name (FN31)."""
    m, f = F.lower(col(mime)), F.lower(col(file))
    out = F.when(m.isin("image/jpeg", "image/jpg") | f.rlike(r"\.jpe?g$"), "jpeg")
    for name, tail in (("png", "png"), ("gif", "gif"), ("tiff", "tiff?"), ("webp", "webp")):
        out = out.when((m == f"image/{name}") | f.rlike(rf"\.{tail}$"), name)
    return out


def mime_of_format(fmt: ColumnLike) -> Column:
    return F.when(col(fmt).isNotNull(), F.concat(F.lit("image/"), F.lower(col(fmt))))


def human_size(n: ColumnLike) -> Column:
    """Bytes with a unit, one decimal at most (FN14)."""
    n = col(n).cast("double")
    out = F.when(n <= 0, "0 B")
    for unit, name in ((1024**3, "GB"), (1024**2, "MB"), (1024, "KB"), (1, "B")):
        value = F.round(n / unit, 1)
        shown = F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))
        out = out.when(n >= unit, F.concat(shown, F.lit(f" {name}")))
    return out


def thumb_bounds(width: ColumnLike, height: ColumnLike, to_width: int, to_height: int) -> Column:
    """Width and height within bounds, at the same ratio, never enlarged (FN15)."""
    w, h = col(width).cast("long"), col(height).cast("long")
    w1 = F.least(w, F.lit(to_width))
    h1 = F.when(w > to_width, F.expr("0L") + F.floor(h * w1 / w)).otherwise(h)
    w2 = F.when(h1 > to_height, F.floor(w1 * to_height / h1)).otherwise(w1)
    return F.when((w > 0) & (h > 0), F.struct(w2.cast("long").alias("width"), F.least(h1, F.lit(to_height)).cast("long").alias("height")))


def parse_colour(c: ColumnLike) -> Column:
    """Red, green, blue, alpha of ``rgb(r,g,b)``, ``#rrggbbaa`` or 6, 3 or 1 hex digits; null if malformed (FN16)."""
    v = F.lower(F.trim(col(c)))
    hexes = F.regexp_replace(v, "^#", "")
    n = F.length(hexes)
    full = F.when(n == 8, hexes).when(n == 6, F.concat(hexes, F.lit("ff")))
    full = full.when(n == 3, F.concat(F.regexp_replace(hexes, "(.)", "$1$1"), F.lit("ff"))).when(n == 1, F.concat(F.repeat(hexes, F.lit(6)), F.lit("ff")))
    digit = lambda i: F.conv(F.substring(full, 2 * i + 1, 2), 16, 10).cast("int")
    part = lambda i: F.regexp_extract(v, r"^rgb\((\d+),\s*(\d+),\s*(\d+)\)$", i).cast("int")
    names = ("red", "green", "blue")
    rgb = F.struct(*(part(i + 1).alias(k) for i, k in enumerate(names)), F.lit(255).alias("alpha"))
    by_hex = F.struct(*(digit(i).alias(k) for i, k in enumerate((*names, "alpha"))))
    return F.when(v.rlike(r"^rgb\(\d{1,3},\s*\d{1,3},\s*\d{1,3}\)$"), rgb).when(hexes.rlike("^[0-9a-f]+$") & full.isNotNull(), by_hex)


def zoom_levels(width: ColumnLike, height: ColumnLike, tile: int = 256) -> Column:
    """Levels of a tile pyramid (FN32)."""
    side = F.greatest(col(width), col(height)).cast("double")
    return F.when(side > 0, F.greatest(F.ceil(F.round(F.log2(side / tile), 9)), F.lit(0)).cast("int") + 1)


def tile_can_exist(zoom: ColumnLike, z: ColumnLike) -> Column:
    return ~((col(zoom) > 0) & (col(z) > col(zoom)))


def mm_per_pixel(pixels: ColumnLike, actual: ColumnLike, units: ColumnLike) -> Column:
    """Calibrated scale (MU13); unknown units count as millimetres."""
    unit = F.lit(1.0)
    for name, mm in MM_PER_UNIT.items():
        unit = F.when(F.lower(col(units)) == name, mm).otherwise(unit)
    return F.when(col(pixels) > 0, col(actual) * unit / col(pixels))


def stage_filter(rule: dict, size: ColumnLike, width: ColumnLike, height: ColumnLike, content_type: ColumnLike, fmt: ColumnLike, animated: ColumnLike, alpha: ColumnLike) -> Column:
    """Whether a file passes a stage's filter (FL28); a format's own minimum goes before the general one."""
    ok = F.lit(True)
    by_format = rule.get("minBytesByFormat") or {}
    least = F.lit(int(rule.get("minBytes") or 0))
    for name, n in by_format.items():
        least = F.when(F.lower(col(fmt)) == name.lower(), int(n)).otherwise(least)
    ok = ok & (col(size) >= least)
    for key, value in (("minWidth", col(width)), ("minHeight", col(height)), ("minPixels", col(width).cast("long") * col(height).cast("long"))):
        if rule.get(key):
            ok = ok & (value >= int(rule[key]))
    if rule.get("contentTypes"):
        any_type = F.lit(False)
        for prefix in rule["contentTypes"]:
            any_type = any_type | F.lower(col(content_type)).startswith(prefix.lower())
        ok = ok & any_type
    for key, value in (("animated", animated), ("alpha", alpha)):
        if rule.get(key) is not None:
            ok = ok & (col(value) == bool(rule[key]))
    return F.coalesce(ok, F.lit(False))


def byte_ranges(header: ColumnLike, total: ColumnLike) -> Column:
    """Ranges of a Range header: arrays of start, end and length (FN22).

    Null or empty gives the whole content; a range without any bound is malformed and gives null.
    """
    h, n = F.trim(F.regexp_replace(col(header), r"^\s*bytes\s*=", "")), col(total).cast("long")

    def one(r: Column) -> Column:
        a, b = F.nullif(F.regexp_extract(r, r"^\s*(\d*)\s*-", 1), F.lit("")).cast("long"), F.nullif(F.regexp_extract(r, r"-\s*(\d*)\s*$", 1), F.lit("")).cast("long")
        start = F.coalesce(a, F.greatest(n - b, F.lit(0)))
        end = F.when(a.isNull() | b.isNull(), n - 1).otherwise(F.least(b, n - 1))
        return F.struct(start.alias("start"), end.alias("end"), (end - start + 1).alias("length"))

    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), (n - 1).alias("end"), n.alias("length")))
    parts = F.split(h, ",")
    bad = F.exists(parts, lambda r: ~r.rlike(r"^\s*(\d+\s*-\s*\d*|-\s*\d+)\s*$"))
    return F.when(F.coalesce(h, F.lit("")) == "", whole).when(~bad, F.transform(parts, one))


def first_rule(name: ColumnLike, value: ColumnLike, rules: list[tuple[str, str, str]]) -> Column:
    """A value formatted by the first rule whose name and pattern match it whole (FN23).

    A rule is (name, pattern, replacement); ``$1`` and so on refer to the pattern's groups.
    """
    out = col(value)
    for key, pattern, shown in reversed(rules):
        whole = f"^(?:{pattern})$"
        out = F.when((F.lower(col(name)) == key.lower()) & col(value).rlike(whole), F.regexp_replace(col(value), whole, shown)).otherwise(out)
    return out
