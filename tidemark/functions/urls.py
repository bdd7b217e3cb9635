"""URLs: credentials, identifiers, derived addresses and admission rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.functions.text import ColumnLike, col

#: Last path segments that name a rendition, not an image.
RENDITIONS = (
    "original",
    "thumbnail",
    "thumbnail_large",
    "thumbnail_xlarge",
    "thumbnail_square",
    "thumbnail_square_black",
    "thumbnail_square_white",
    "thumbnail_square_darkGrey",
    "thumbnail_square_darkGray",
    "thumbnail_centre_crop",
    "thumbnail_centre_crop_large",
)
#: Parts of parameter names that make a query string sensitive.
SENSITIVE = ("token", "key", "secret", "password", "signature", "credential", "auth")


def drop_credentials(c: ColumnLike) -> Column:
    """A URL without its user info (FN4)."""
    return F.regexp_replace(col(c), "://[^/@]+@", "://")


def strip_credentials(c: ColumnLike) -> Column:
    """As ``drop_credentials``; blank gives empty text (FN11)."""
    return F.when(F.trim(col(c)) == "", "").otherwise(drop_credentials(c))


def mask_credentials(c: ColumnLike, admin: bool = False) -> Column:
    """User and password as ``****:****``, a user alone as ``****``; administrators see all (FN11)."""
    u = col(c)
    if admin:
        return u
    both = F.regexp_replace(u, r"^(\w[\w+.-]*://)[^/@:]+:[^/@]*@", "$1****:****@")
    return F.when(u.rlike(r"^\w[\w+.-]*://[^/@:]+:[^/@]*@"), both).otherwise(F.regexp_replace(u, r"^(\w[\w+.-]*://)[^/@]+@", "$1****@"))


def starts_with_any(c: ColumnLike, prefixes: list[str]) -> Column:
    """Whether a URL is below one of the configured prefixes (FL30)."""
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(col(c), F.lit(p))
    return F.coalesce(out, F.lit(False))


def image_id(c: ColumnLike, prefixes: list[str]) -> Column:
    """The id in one of the service's own URLs, else empty (FN12)."""
    u = col(c)
    path = F.regexp_extract(u, r"^\w+://[^/?#]*/?([^?#]*)", 1)
    parts = F.split(path, "/")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    has = lambda name: query.rlike(rf"(^|&){name}(=|&|$)")
    value = lambda name: F.regexp_extract(query, rf"(?:^|&){name}=([^&]*)", 1)
    found = F.when(has("id"), value("id")).when(has("imageId"), value("imageId")).otherwise(F.element_at(parts, -1))
    found = F.when(found.isin(*RENDITIONS) & (F.size(parts) >= 2), F.try_element_at(parts, F.lit(-2))).otherwise(found)
    return F.when(starts_with_any(u, prefixes), found).otherwise("")


def file_name(c: ColumnLike) -> Column:
    """The last segment of a path or URL, without query and fragment (FN13)."""
    return F.regexp_extract(F.regexp_replace(col(c), "[?#].*$", ""), "[^/]*$", 0)


def storage_path(c: ColumnLike, *suffix: str) -> Column:
    """Last four characters of an id, reversed, then the id, then a suffix (FN17)."""
    r = F.reverse(col(c))
    return F.concat_ws("/", *(F.substring(r, i, 1) for i in range(1, 5)), col(c), *map(F.lit, suffix))


def rendition_url(base: str, c: ColumnLike, rendition: str) -> Column:
    """The address of a rendition (FN18)."""
    return F.concat(F.lit(f"{base}/store/"), storage_path(c), F.lit(f"/{rendition}"))


def tile_url(base: str, c: ColumnLike, z: ColumnLike, x: ColumnLike, y: ColumnLike) -> Column:
    return F.concat_ws("/", F.lit(f"{base}/store"), storage_path(c), F.lit("tms"), *(col(v).cast("string") for v in (z, x)), F.concat(col(y).cast("string"), F.lit(".png")))


def is_uuid(c: ColumnLike) -> Column:
    return F.coalesce(col(c).rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.lit(False))


def has_sensitive_params(query: ColumnLike) -> Column:
    """Whether a parameter's name contains a sensitive word (FN35)."""
    names = F.transform(F.split(F.lower(col(query)), "&"), lambda p: F.regexp_extract(p, "^[^=]*", 0))
    return F.coalesce(F.exists(names, lambda n: n.rlike("|".join(SENSITIVE))), F.lit(False))


def may_redirect(source: ColumnLike, target: ColumnLike) -> Column:
    """Whether a redirect may be followed (FL29): same host or https, no downgrade, no user info, nothing sensitive to another host."""
    part = lambda c, name: F.try_parse_url(col(c), F.lit(name))
    scheme, host = F.lower(part(target, "PROTOCOL")), F.lower(part(target, "HOST"))
    known = scheme.isin("http", "https") & host.isNotNull()
    down = (F.lower(part(source, "PROTOCOL")) == "https") & (scheme == "http")
    info = part(target, "USERINFO").isNotNull()
    other = F.lower(part(source, "HOST")) != host
    leaks = other & has_sensitive_params(part(target, "QUERY"))
    return F.coalesce(known & ~down & ~info & ~leaks, F.lit(False))
