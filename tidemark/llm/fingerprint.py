"""Document fingerprints by order min-hash, in DataFrame functions only.

A document's k-mers of ``K`` tokens are hashed; those that occur again are numbered by
occurrence and hashed with their number, so that all differ. The top bits of a hash choose
one of ``BINS`` bins. Each bin keeps its ``KEEP`` smallest hashes, puts them in text order,
and hashes the tuple; the tuples are the signature. Moving a passage changes the order in a
tuple, so likeness falls with edits that leave the set of k-mers alone.

A k-mer is one long, 40 bits of hash above 24 bits of position, so sorting does the grouping:
equal k-mers are neighbours, bins are runs, and occurrence numbers are found by doubling
steps back along a run.

Defined results: a null text is empty, and an empty one has no tuples; two documents without
tuples have likeness 1. A text of fewer than K tokens is one k-mer. Texts are read whole;
a token is a run without white space, but characters of scripts that write words without spaces
are tokens each; positions beyond 2^24 tokens count as 2^24. Every row has its own fingerprint. Null ids come after all others, and
rows that repeat an id follow each other in the order of their texts' hashes. Extra columns
are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.plans.lineage import cut

K = 3
BIN_BITS = 6
KEEP = 2
#: Consecutive ids that share a window, as a power of two.
GROUP_BITS = 8
#: Groups' first ids, two longs each, that are broadcast rather than joined by a shuffle of the texts.
BROADCAST = 200_000

_POS = 24
_LOW = (1 << _POS) - 1
_HASH_BITS = 64 - BIN_BITS - _POS
#: Blocks of scripts that write words without spaces (Thai, Lao, Burmese, Khmer, kana, Han).
_ALONE = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
_TOKEN = rf"[{_ALONE}]|[^\x20\x09-\x0D{_ALONE}]+"


def _bin(x: Column) -> Column:
    return F.shiftright(x, 64 - BIN_BITS)


def _mer(h: Column, i: Column) -> Column:
    return h.bitwiseAND(~_LOW).bitwiseOR(F.least(i.cast("long"), F.lit(_LOW)))


def with_signature(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the array of tuple hashes of the column ``text``."""
    t, m = f"__t_{out}", f"__m_{out}"
    df = df.withColumn(t, F.regexp_extract_all(F.col(text), F.lit(_TOKEN), F.lit(0)))
    tokens = F.col(t)
    mers = F.transform(
        F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - (K - 1), F.lit(0))), lambda w, i: _mer(F.xxhash64(w, *(F.get(tokens, i + j) for j in range(1, K))), i)
    )
    short = F.when(F.size(tokens) > 0, F.array(_mer(F.xxhash64(tokens), F.lit(0)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(m, F.sort_array(F.when(F.size(tokens) >= K, mers).otherwise(short))).drop(t)

    run = F.col(m)

    def numbered(x: Column, i: Column) -> Column:
        def same(k: Column) -> Column:
            return F.shiftright(F.get(run, i - k), _POS) == F.shiftright(x, _POS)

        steps = F.array(*(F.lit(1 << b) for b in reversed(range(_POS))))
        nth = F.aggregate(steps, F.lit(0), lambda k, step: F.when(same(k + step), k + step).otherwise(k))
        return F.when(same(F.lit(1)), _mer(F.xxhash64(F.shiftright(x, _POS), nth), x.bitwiseAND(_LOW))).otherwise(x)

    df = df.withColumn(m, F.sort_array(F.transform(run, numbered)))

    least = F.filter(F.col(m), lambda x, i: F.coalesce(_bin(F.get(F.col(m), i - KEEP)) != _bin(x), F.lit(True)))
    df = df.withColumn(m, least)
    # bin, position, hash: sorting now puts each bin's k-mers in text order
    top = -(1 << (64 - BIN_BITS))
    swapped = F.transform(
        F.col(m), lambda x: x.bitwiseAND(top).bitwiseOR(F.shiftleft(x.bitwiseAND(_LOW), _HASH_BITS)).bitwiseOR(F.shiftright(x, _POS).bitwiseAND((1 << _HASH_BITS) - 1))
    )
    df = df.withColumn(m, F.sort_array(swapped))

    def tuple_hash(x: Column, i: Column) -> Column:
        def part(j: int) -> Column:
            y = F.get(F.col(m), i + j)
            return F.when(_bin(y) == _bin(x), y.bitwiseAND((1 << _HASH_BITS) - 1)).otherwise(F.lit(-1))

        first = F.coalesce(_bin(F.get(F.col(m), i - 1)) != _bin(x), F.lit(True))
        return F.when(first, F.xxhash64(_bin(x), x.bitwiseAND((1 << _HASH_BITS) - 1), *(part(j) for j in range(1, KEEP))))

    return df.withColumn(out, F.filter(F.transform(F.col(m), tuple_hash), lambda x: x.isNotNull())).drop(m)


def likeness(a: Column | str, b: Column | str) -> Column:
    """The KEEP-th root of the share of equal tuples, 0 to 1: an estimate of how much of the k-mers two texts share."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(F.pow(F.size(F.array_intersect(a, b)) / most, F.lit(1.0 / KEEP)))


def as_text(signature: Column | str) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def following(ids: DataFrame, bits: int = 12) -> DataFrame:
    """``(b, next)`` for the distinct whole numbers b of ``ids``: the next smaller one, and after the smallest the largest.

    Numbers that share all but their last ``bits`` bits form a window; only the last of each
    asks for the next window's largest, by the same rule one level up.
    """
    lo, hi = ids.agg(F.min("b"), F.max("b")).first()
    if lo is None or hi - lo < 1 << bits:
        w = W.partitionBy(F.lit(0)).orderBy(F.desc("b"))
        return ids.select("b", F.coalesce(F.lead("b").over(w), F.max("b").over(W.partitionBy(F.lit(0)))).alias("next"))
    ids = ids.withColumn("g", F.shiftright("b", bits))
    inside = ids.withColumn("next", F.lead("b").over(W.partitionBy("g").orderBy(F.desc("b"))))
    tops = ids.groupBy("g").agg(F.max("b").alias("top"))
    order = following(tops.select(F.col("g").alias("b")), bits).withColumnRenamed("next", "ng").withColumnRenamed("b", "g")
    order = order.join(tops.withColumnRenamed("g", "ng"), "ng").select("g", "top")
    return inside.join(order, "g").select("b", F.coalesce("next", "top").alias("next"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The edited text has the last half of its characters replaced by as many of the first of
    the next document by descending doc_id; after the last comes the first.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    none = -(1 << 63)
    group = F.shiftright(F.coalesce("doc_id", F.lit(none)), GROUP_BITS)
    ids = cut(docs.groupBy(group.alias("b")).agg(F.max(F.coalesce("doc_id", F.lit(none))).alias("head")))
    order = following(ids.select("b"))
    # The first document of the next group follows the last one of a group.
    heads = ids.join(order.select(F.col("b").alias("for"), F.col("next").alias("b")), "b").select("for", "head")
    if ids.count() <= BROADCAST:
        heads = F.broadcast(heads)
    first = docs.join(heads, F.coalesce(docs["doc_id"], F.lit(none)) == heads["head"]).select("for", "text")
    first = with_signature(first.groupBy("for").agg(F.min_by("text", F.xxhash64("text")).alias("first_text")), "first_text", "first_sig")

    known = with_signature(docs.withColumn("b", group).repartition("b"), "text", "sig")  # texts are dealt out once; signatures aren't
    w = W.partitionBy("b").orderBy(F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    pairs = known.withColumn("after", F.lead(F.struct("text", "sig")).over(w)).join(first.withColumnRenamed("for", "b"), "b", "left")
    after = F.coalesce("after", F.struct(F.col("first_text").alias("text"), F.col("first_sig").alias("sig")))
    pairs = pairs.select("doc_id", "text", "sig", after["text"].alias("next_text"), after["sig"].alias("next_sig"), F.length("text").alias("n"))
    half = F.expr("n div 2").cast("int")
    edited = F.concat(F.left("text", (F.col("n") - half).cast("int")), F.left("next_text", half))
    out = with_signature(pairs.select("doc_id", "sig", "next_sig", "n", edited.alias("edited")), "edited", "edited_sig")
    return out.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        as_text("sig").alias("fingerprint"),
        as_text("edited_sig").alias("edited_fingerprint"),
        likeness("sig", "edited_sig").alias("near_edited"),
        likeness("sig", "next_sig").alias("near_next"),
    )
