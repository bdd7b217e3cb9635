"""Text cleaning and small conversions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def one_line(c: ColumnLike) -> Column:
    """Runs of line ends become one space (FN1)."""
    return F.regexp_replace(col(c), r"[\n\r]+", " ")


def drop_first_marks(c: ColumnLike) -> Column:
    """The first run of pipes, quotes and ampersands goes; later ones stay (FN2)."""
    return F.regexp_replace(col(c), r"(?s)^([^|'\"&]*)[|'\"&]+", "$1")


def drop_marks(c: ColumnLike) -> Column:
    """All pipes, quotes and ampersands go (FN3)."""
    return F.translate(col(c), "\"|'&", "")


def strip_control(c: ColumnLike) -> Column:
    """Control characters go; what is then empty becomes null (FN5)."""
    return F.nullif(F.regexp_replace(col(c), r"[\x00-\x1F\x7F-\x9F]", ""), F.lit(""))


def joined(*parts: ColumnLike) -> Column:
    """Concatenation that skips nulls (FN7)."""
    return F.concat_ws("", *map(col, parts))


def day(c: ColumnLike) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd")


def month(c: ColumnLike) -> Column:
    return F.date_format(col(c), "yyyy-MM")


def second(c: ColumnLike) -> Column:
    """Date and time as info output shows them (FN29)."""
    return F.date_format(col(c), "yyyy-MM-dd HH:mm:ss")


def exif_date(c: ColumnLike) -> Column:
    """EXIF dates, read with 24 hours (FN28); null if malformed."""
    return F.try_to_timestamp(col(c), F.lit("yyyy:MM:dd HH:mm:ss"))


def or_default(c: ColumnLike, default: str) -> Column:
    """``default`` for null and empty text (PJ16, FN36)."""
    return F.coalesce(F.nullif(col(c), F.lit("")), F.lit(default))


def sanitise_value(c: ColumnLike) -> Column:
    """A metadata value: null is empty, a NUL character gives base64, else trimmed (FN20)."""
    v = col(c)
    return F.when(v.isNull(), "").when(F.instr(v, "\0") > 0, F.base64(v.cast("binary"))).otherwise(F.trim(v))


def part(c: ColumnLike, mark: str, n: int) -> Column:
    """The n-th part of a text that is cut at a mark, empty beyond the last (FN8)."""
    return F.split_part(col(c), F.lit(mark), F.lit(n))


def url_decoded(c: ColumnLike) -> Column:
    """Percent-encoded text in clear (FN26); null if malformed."""
    return F.try_url_decode(col(c))


def parsed(c: ColumnLike, schema: str) -> Column:
    """JSON text as a struct (FN33); null if malformed."""
    return F.from_json(col(c), schema)


def as_flag(c: ColumnLike) -> Column:
    """Form values that mean true (FN41)."""
    return F.coalesce(F.lower(col(c).cast("string")).isin("true", "on"), F.lit(False))


def flag_text(c: ColumnLike) -> Column:
    """A boolean as text, null as false (FN34)."""
    return F.coalesce(col(c).cast("string"), F.lit("false"))


def highlight(c: ColumnLike, term: str, size: int = 60) -> Column:
    """A fragment around the first match, matches in bold (FN37); null without a match."""
    import re

    v = col(c)
    at = F.locate(term.lower(), F.lower(v))
    fragment = F.substring(v, F.greatest(at - (size - len(term)) // 2, F.lit(1)), F.lit(size))
    return F.when(at > 0, F.regexp_replace(fragment, f"(?i)({re.escape(term)})", "<b>$1</b>"))
