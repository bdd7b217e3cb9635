"""Search: criteria in two dialects, free text, filters, facets and pages.

A criterion is ``(field, kind, text)``. Kinds are integer, double, date, string, boolean and
metadata. The grammar of the text is ``eq|gt|lt value``, ``bt low:high``, ``eq|gt|lt
field(name)``, or a list of values. The ``db`` dialect makes an integer's ``gt`` strict and
reads ``|`` lists as any-of and single strings as case-insensitive patterns; the ``index``
dialect has inclusive bounds and ``~`` lists, any-of or all-of.
"""

from __future__ import annotations

import functools
import operator
import re
from dataclasses import dataclass
from urllib.parse import unquote_plus

from pyspark.sql import Column, DataFrame, Window as W, functions as F

PAGE, PAGE_MAX, OFFSET_MAX, FACET_MAX, FACET_TOP = 10, 200, 10_000, 10_000, 10


@dataclass(frozen=True)
class Criterion:
    field: str
    kind: str
    text: str
    units: str = ""


def _number(kind: str, v: str) -> Column:
    if kind == "date":
        return F.to_timestamp(F.lit(v.strip()), "d/M/yyyy")
    return F.lit(int(v)) if kind == "integer" else F.lit(float(v))


def predicate(c: Criterion, dialect: str = "db", mode: str = "any") -> Column:
    """A criterion as a boolean column (FL1 to FL8, FL10)."""
    col = F.col(c.field)
    if c.kind in ("integer", "double", "date"):
        m = re.fullmatch(r"\s*(eq|gt|lt)\s+field\((\w+)\)\s*", c.text)
        if m:
            if dialect != "db":
                raise ValueError("columns are compared in the db dialect only")
            other = F.col(m[2])
            return {"eq": col == other, "gt": col > other, "lt": col <= other}[m[1]]
        m = re.fullmatch(r"\s*(eq|gt|lt|bt)\s+(.+?)\s*", c.text)
        if not m:
            raise ValueError(f"not a criterion: {c.text!r}")
        if m[1] == "bt":
            a, b = (_number(c.kind, v) for v in m[2].split(":"))
            return col.between(F.least(a, b), F.greatest(a, b))
        v = _number(c.kind, m[2])
        strict = dialect == "db" and c.kind == "integer"
        return {"eq": col == v, "gt": col > v if strict else col >= v, "lt": col <= v}[m[1]]
    if c.kind == "boolean":
        return col == (c.text.strip().lower() in ("true", "on", "eq true"))
    if c.kind == "metadata":
        return metadata_predicate(c.text)
    values = c.text.split("|" if dialect == "db" else "~")
    if dialect == "db":
        return F.ilike(col, F.lit(values[0])) if len(values) == 1 else col.isin(values)
    hits = [F.lower(col) == v.lower() for v in values]
    return functools.reduce(operator.and_ if mode == "all" else operator.or_, hits)


def metadata_predicate(text: str) -> Column:
    """``name:value`` of a metadata row, cut at the last colon; ``*`` is any text (FL10)."""
    m = re.fullmatch(r"(.*):(.*)", text, re.S)
    if not m:
        raise ValueError(f"not a metadata criterion: {text!r}")
    return (F.lower("name") == m[1].lower()) & F.ilike(F.col("value"), F.lit(m[2].replace("*", "%")))


def where_all(df: DataFrame, criteria: list[Criterion], metadata: DataFrame | None = None, dialect: str = "db", mode: str = "any") -> DataFrame:
    """All criteria together (FL9); those on metadata must hold on one metadata row (JN3)."""
    plain = [predicate(c, dialect, mode) for c in criteria if c.kind != "metadata"]
    on_rows = [metadata_predicate(c.text) for c in criteria if c.kind == "metadata"]
    out = df.where(functools.reduce(operator.and_, plain)) if plain else df
    if on_rows:
        rows = metadata.where(functools.reduce(operator.and_, on_rows)).select(F.col("image_id").alias("__image"))
        out = out.join(rows, F.col("id") == F.col("__image"), "left_semi")
    return out


def filter_queries(df: DataFrame, fq: list[str]) -> DataFrame:
    """``field:value`` filters, exact and all together; malformed ones are ignored (FL12)."""
    for f in fq:
        field, colon, value = f.partition(":")
        if colon and field in df.columns:
            df = df.where(F.col(field).cast("string") == value)
    return df


def has_words(field: str, words: str) -> Column:
    """Whether a field has these words next to each other, without regard to case; null has none (FL11).

    With Spark's own operators on columns this takes the place of a query language: ``has_words("title", "red cat") & ~(F.col("n") > 5)``.
    """
    spaced = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"\W+", " ")), F.lit(" "))
    return F.coalesce(F.contains(spaced(F.col(field).cast("string")), spaced(F.lit(words))), F.lit(False))


def page(df: DataFrame, size: int | None = None, offset: int | None = None, newest: str = "date_uploaded", tie: str = "image_identifier") -> DataFrame:
    """A page of hits, newest first (SL1 to SL3)."""
    size = PAGE if size is None else min(size, PAGE_MAX)
    offset = offset or 0
    if offset > OFFSET_MAX:
        offset = OFFSET_MAX - size
    return df.orderBy(F.desc(newest), tie).offset(offset).limit(size)


def page_with_total(df: DataFrame, size: int | None = None, offset: int | None = None) -> DataFrame:
    """A page of hits, each with the exact number of all hits (AG4)."""
    return page(df, size, offset).withColumn("total", df.agg(F.count("*").alias("n")).scalar())


def search_by_metadata(images: DataFrame, metadata: DataFrame, key: str, values: list[str], sort: str, order: str = "desc", size: int = 10, offset: int = 0) -> DataFrame:
    """Images that have one of the values of a metadata key, by a column of the user's choice, descending unless ``asc`` is said (SL5)."""
    rows = metadata.where((F.lower("name") == key.lower()) & F.lower("value").isin([v.lower() for v in values])).select(F.col("image_id").alias("id"))
    by = F.asc(sort) if order == "asc" else F.desc(sort)
    return images.join(rows, "id", "left_semi").orderBy(by, F.desc("id")).offset(offset).limit(size)


def ordered(df: DataFrame, sort: str | None = None, order: str = "asc") -> DataFrame:
    """Rows by a column, else by id, the newest first (SL6, SL9)."""
    return df.orderBy(F.desc("id")) if sort is None else df.orderBy(F.desc(sort) if order == "desc" else F.asc(sort), F.desc("id"))


def index_fields(index: DataFrame) -> DataFrame:
    """Names and types of the index's fields, and in how many documents each has a value (SC20)."""
    cells = F.array(*(F.struct(F.lit(f.name).alias("field"), F.lit(f.dataType.simpleString()).alias("kind"), F.col(f.name).isNotNull().cast("long").alias("filled")) for f in index.schema))
    return index.select(F.inline(cells)).groupBy("field", "kind").agg(F.sum("filled").alias("filled"))


def facets(df: DataFrame, fields: list[str], top: int = FACET_TOP) -> DataFrame:
    """``facet, value, n``: the most frequent values of each field, in one pass (AG1, AG3)."""
    pairs = F.array(*(F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in fields))
    counts = df.select(F.inline(pairs)).where(F.col("value").isNotNull()).groupBy("facet", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("facet").orderBy(F.desc("n"), "value"))
    return counts.withColumn("r", rank).where(F.col("r") <= top).drop("r")


def facet(df: DataFrame, field: str, most: int = FACET_MAX) -> DataFrame:
    """All values of one field by value (AG2)."""
    return df.where(F.col(field).isNotNull()).groupBy(F.col(field).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy("value").limit(most)


def grouped_by_value(df: DataFrame, field: str, values: list[str]) -> DataFrame:
    """Hits of each value of a field, a row each (AG12); ``facet`` counts them."""
    return df.where(F.col(field).isin(values)).select(F.col(field).alias("value"), "image_identifier")


def latest_for_url(images: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted URL the newest image that has it as original or alternate name (FL18, WN1)."""
    names = images.select("id", "image_identifier", "date_uploaded", F.explode(F.array_distinct(F.array_append(F.coalesce("alternate_filename", F.array().cast("array<string>")), F.col("original_filename")))).alias("url"))
    hits = names.join(wanted.select("url").distinct(), "url")
    newest = F.max_by(F.struct("id", "image_identifier"), F.struct("date_uploaded", "id")).alias("i")
    return hits.groupBy("url").agg(newest).select("url", "i.id", "i.image_identifier")


def by_file_name(images: DataFrame, name: str) -> DataFrame:
    """By file name, percent-encoded as in a URL (FN26), with ``*`` and then ``%`` as any text (FL17)."""
    pattern = unquote_plus(name).replace("*", "%")
    return images.where(F.ilike(F.col("original_filename"), F.lit(pattern)) if "%" in pattern else F.col("original_filename") == pattern)


def by_file_names(images: DataFrame, names: DataFrame) -> DataFrame:
    """Images that have any of some file names (FL36)."""
    return images.join(names.select(F.col("name").alias("original_filename")).distinct(), "original_filename", "left_semi")


def found_and_missing(images: DataFrame, ids: DataFrame) -> DataFrame:
    """Each requested identifier and whether there is such an image (JN23, SO5)."""
    have = images.select("image_identifier").distinct().withColumn("found", F.lit(True))
    return ids.select("image_identifier").distinct().join(have, "image_identifier", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def by_id_or_identifier(images: DataFrame, key: str) -> DataFrame:
    """By number, else by identifier (FL34)."""
    return images.where(F.col("id") == int(key)) if key.isdigit() else images.where(F.col("image_identifier") == key)


def describe(c: Criterion) -> str:
    """A criterion in words (FN24)."""
    m = re.fullmatch(r"\s*(eq|gt|lt|bt)\s+(.+?)\s*", c.text)
    unit = f" {c.units}" if c.units else ""
    if m and m[1] == "bt":
        a, b = m[2].split(":")
        return f"{c.field} is between {a} and {b}{unit}"
    if m:
        words = {"eq": "is equal to", "gt": "is greater than or equal to", "lt": "is less than or equal to"}[m[1]]
        return f"{c.field} {words} {m[2]}{unit}"
    values = re.split(r"[|~]", c.text)
    return f"{c.field} matches {values[0]}" if len(values) == 1 else f"{c.field} is one of {', '.join(values)}"


def encode_value(kind: str, form: dict[str, str]) -> str:
    """Form fields ``op``, ``value``, ``value2`` as a criterion's text (FN25)."""
    if kind in ("integer", "double", "date"):
        op = form.get("op", "eq")
        return f"bt {form['value']}:{form['value2']}" if op == "bt" else f"{op} {form['value']}"
    values = form.get("value", "")
    return "|".join(values) if isinstance(values, (list, tuple)) else str(values)


class CriteriaList:
    """The criteria of a session: add, replace, remove, clear (MU16), grouped by kind (AG20)."""

    def __init__(self):
        self._items: dict[int, Criterion] = {}
        self._next = 1

    def add(self, c: Criterion) -> int:
        self._items[self._next] = c
        self._next += 1
        return self._next - 1

    def replace(self, key: int, text: str) -> None:
        old = self._items[key]
        self._items[key] = Criterion(old.field, old.kind, text, old.units)

    def remove(self, key: int) -> None:
        self._items.pop(key, None)

    def clear(self) -> None:
        self._items.clear()

    def all(self) -> list[Criterion]:
        return list(self._items.values())

    def by_kind(self) -> dict[str, list[Criterion]]:
        out: dict[str, list[Criterion]] = {}
        for c in self._items.values():
            out.setdefault(c.kind, []).append(c)
        return out
