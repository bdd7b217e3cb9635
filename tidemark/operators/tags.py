"""Hierarchical tags: paths such as ``/animal/bird``, every ancestor stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.text import ColumnLike, col
from tidemark.plans.lineage import cut


def normal(path: ColumnLike) -> Column:
    """Lower case, with exactly one leading slash."""
    return F.concat(F.lit("/"), F.regexp_replace(F.lower(col(path)), "^/", ""))


def prefixes(path: ColumnLike) -> Column:
    """A path and all its ancestors, the shortest first."""
    parts = F.filter(F.split(normal(path), "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))


def parent(path: ColumnLike) -> Column:
    return F.regexp_replace(col(path), "/[^/]*$", "")


def label(path: ColumnLike) -> Column:
    """The last element (TG11)."""
    return F.element_at(F.split(col(path), "/"), -1)


def create(tags: DataFrame, wanted: DataFrame) -> DataFrame:
    """Paths to insert so that each wanted path and its ancestors exist (TG1)."""
    return wanted.select(F.explode(prefixes("path")).alias("path")).where("path <> '/'").distinct().join(tags.select("path"), "path", "left_anti")


def subtree(tags: DataFrame, path: str) -> DataFrame:
    """Descendants of a path (FL22); no part of the path is a pattern."""
    return tags.where(F.lower("path").startswith(path.lower() + "/"))


def move(tags: DataFrame, path: str, new_parent: str) -> DataFrame:
    """All tags, with a path and its descendants below another parent (TG2)."""
    return _replace_prefix(tags, path, new_parent.rstrip("/") + "/" + path.rsplit("/", 1)[1])


def rename(tags: DataFrame, path: str, name: str) -> DataFrame:
    """All tags, with the last element of a path renamed (TG3)."""
    return _replace_prefix(tags, path, path.rsplit("/", 1)[0] + "/" + name.lower())


def _replace_prefix(tags: DataFrame, old: str, new: str) -> DataFrame:
    inside = (F.col("path") == old) | F.col("path").startswith(old + "/")
    return tags.withColumn("path", F.when(inside, F.concat(F.lit(new), F.expr(f"substring(path, {len(old) + 1})"))).otherwise(F.col("path")))


def delete(tags: DataFrame, links: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Tags and image links without a subtree (TG4)."""
    gone = tags.where((F.col("path") == path) | F.col("path").startswith(path + "/")).select(F.col("id").alias("tag_id"))
    return tags.join(gone, tags["id"] == gone["tag_id"], "left_anti"), links.join(gone, "tag_id", "left_anti")


def attach(links: DataFrame, wanted: DataFrame) -> DataFrame:
    """Links (image, path) to insert so that images have the wanted tags and their ancestors (TG5)."""
    every = wanted.select("image_id", F.explode(prefixes("path")).alias("path")).distinct()
    return every.join(links.select("image_id", "path"), ["image_id", "path"], "left_anti")


def detach(links: DataFrame, gone: DataFrame) -> DataFrame:
    """Links that are left when tags are detached: an ancestor stays while another descendant of it does (TG6)."""
    rest = links.join(gone.select("image_id", "path"), ["image_id", "path"], "left_anti")
    above = gone.select("image_id", F.explode(prefixes("path")).alias("path"), F.col("path").alias("of")).where("path <> of").select("image_id", "path").distinct()
    gone_rows = gone.select("image_id", "path").withColumn("g", F.lit(True))
    # leaves that remain, other than the ancestors in question
    doubtful = rest.join(above, ["image_id", "path"], "left_semi")
    firm = rest.join(above, ["image_id", "path"], "left_anti").join(gone_rows, ["image_id", "path"], "left_anti")
    held = firm.select("image_id", F.explode(prefixes("path")).alias("path")).distinct()
    return firm.select("image_id", "path").unionByName(doubtful.join(held, ["image_id", "path"], "left_semi").select("image_id", "path"))


def keywords(links: DataFrame) -> DataFrame:
    """Distinct path elements of each image's tags (TG7, SO3)."""
    return links.select("image_id", F.explode(F.split("path", "/")).alias("keyword")).where("keyword <> ''").distinct()


def leaves(paths: DataFrame, *keys: str) -> DataFrame:
    """Paths without a child, within each key (TG8). Every ancestor is stored, so a parent is one element shorter."""
    parents = paths.select(*keys, parent("path").alias("path")).distinct()
    return paths.join(parents, [*keys, "path"], "left_anti")


def ancestors_longest_first(tags: DataFrame, path: str) -> DataFrame:
    """Stored ancestors of a path (SL11)."""
    above = tags.sparkSession.createDataFrame([(path,)], "path string").select(F.explode(prefixes("path")).alias("path")).where(F.col("path") != path)
    return tags.join(above, "path", "left_semi").orderBy(F.desc(F.length("path")))


def tree(tags: DataFrame, query: str = "") -> DataFrame:
    """Every path of the tree with parent, depth and label; what isn't stored itself is disabled (TG9, FL21)."""
    rows = tags.where(F.lower("path").contains(query.lower())) if query else tags
    every = rows.select(F.explode(prefixes("path")).alias("path")).distinct()
    stored = tags.select("path").distinct().withColumn("stored", F.lit(True))
    out = every.join(stored, "path", "left")
    return out.select("path", parent("path").alias("parent"), (F.size(F.split("path", "/")) - 1).alias("depth"), label("path").alias("label"), F.col("stored").isNull().alias("disabled"))


def nested(tags: DataFrame, query: str = "") -> DataFrame:
    """``name, node``: for each root of the tree one JSON text, children within (TG9).

    Children are folded into their parents a level at a time, from the deepest on. A node that is no tag itself is
    disabled and has the number of the first tag, by path, that lies below it; children come in the order of their first
    paths. With a ``query``, only tags whose path holds it make the tree.
    """
    rows = (tags.where(F.lower("path").contains(query.lower())) if query else tags).select("id", F.concat(F.lit("/"), F.regexp_replace("path", "^/", "")).alias("path"))
    parts = F.split(F.substring("path", 2, 1 << 30), "/")
    each = rows.select("id", "path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.slice(parts, F.lit(1), k))).alias("depth", "at"))
    nodes = each.groupBy("depth", "at").agg(F.min(F.struct("path", "id")).alias("first"), F.max(F.size("at") == F.size(F.split("path", "/")) - 1).alias("stored"))
    nodes = cut(nodes.select("depth", "at", F.slice("at", F.lit(1), F.col("depth")).alias("above"), F.col("first.path").alias("first"), F.col("first.id").alias("id"), "stored"))
    deepest = nodes.agg(F.max("depth")).first()[0]
    if deepest is None:
        return tags.sparkSession.createDataFrame([], "name string, node string")
    text = F.regexp_extract(F.to_json(F.array(F.element_at("at", -1))), r"(?s)^\[(.*)\]$", 1)
    children = None
    for depth in range(deepest, -1, -1):
        level = nodes.where(F.col("depth") == depth)
        level = level.withColumn("children", F.lit("")) if children is None else level.join(children, "at", "left")
        node = F.concat(
            F.lit('{"name":'), text, F.lit(',"text":'), text, F.lit(',"children":['), F.coalesce("children", F.lit("")), F.lit('],"icon":false,"tagId":'), F.coalesce(F.col("id").cast("string"), F.lit("null")),
            F.lit(',"state":{"disabled":'), (~F.col("stored")).cast("string"), F.lit("}}"),
        )
        made = level.select("at", "above", "first", node.alias("node"))
        children = made.groupBy(F.col("above").alias("at")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "node"))), lambda c: c["node"]), ",").alias("children"))
    return made.select(F.element_at("at", 1).alias("name"), "node")


def images_by_keyword(images: DataFrame, words: DataFrame, keyword: str, size: int = 100, offset: int = 0) -> DataFrame:
    """A page of images with a keyword, by id (TG10, JN5, SL8)."""
    hits = words.where(F.col("keyword") == keyword.lower()).select(F.col("image_id").alias("id")).distinct().orderBy("id").offset(offset).limit(size)
    return images.join(hits, "id", "left_semi")
