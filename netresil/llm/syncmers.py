"""Document fingerprints from closed syncmers over words.

A text is cut into words (runs of more than sixteen characters into pieces of
sixteen, so that text without spaces has words as well). Of all runs of ``k``
words those are chosen whose smallest inner run of ``s`` words, by hash, lies at
the left or right edge. The choice depends on the ``k`` words alone, not on what
surrounds them, so shared passages choose the same anchors wherever they stand.
The fingerprint keeps the ``anchors`` smallest hashes of the chosen runs, without
their places: likeness is an estimate, and nothing is matched by position (figures
in the README).

Everything is built-in functions on arrays; only the fingerprints of neighbours
and the texts themselves move, once. Road-network records hold no running text,
so the operator is general.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K, S, ANCHORS = 5, 2, 64


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``, also within inner lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _from_hashes(h: Column, k: int, s: int, anchors: int) -> Column:
    inner = k - s + 1
    n = F.size(h)

    def choose(m: Column) -> Column:
        edges = lambda i: F.least(F.get(m, i), F.get(m, i + (inner - 1)))
        middle = [lambda i, j=j: F.get(m, i + j) for j in range(1, inner - 1)]
        closed = (lambda i: edges(i) <= (F.least(*[f(i) for f in middle]) if len(middle) > 1 else middle[0](i))) if middle else (lambda i: F.lit(True))
        places = F.filter(F.sequence(F.lit(0), n - k), closed)
        return F.transform(places, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]).bitwiseAND(F.lit(0xFFFFFFFF)))

    runs = F.transform(F.sequence(F.lit(0), n - s), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(s)]))
    chosen = F.when(n >= k, _let(runs, choose)).when(n > 0, F.array(F.xxhash64(h).bitwiseAND(F.lit(0xFFFFFFFF)))).otherwise(F.array().cast("array<bigint>"))
    return F.slice(F.sort_array(F.array_distinct(chosen)), 1, anchors)


def sketch(text: Column, k: int = K, s: int = S, anchors: int = ANCHORS) -> Column:
    """The ``anchors`` smallest distinct anchor hashes (32 bits), ascending.

    A text of fewer than ``k`` words has one anchor, all its words; a text
    without words, or null, has none.
    """
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]{1,16}"), F.lit(0))
    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _from_hashes(h, k, s, anchors))


def fingerprint(anchors: Column) -> Column:
    """Anchor hashes as one string, eight hexadecimal digits each."""
    return F.array_join(F.transform(anchors, lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")), "")


def likeness(a: Column, b: Column, anchors: int = ANCHORS) -> Column:
    """Share of the smallest anchors of both texts that both have: an estimate
    of the Jaccard similarity of their anchors. Two texts without anchors are alike."""
    least = F.slice(F.sort_array(F.array_union(a, b)), 1, anchors)
    both = F.size(F.array_intersect(least, F.array_intersect(a, b)))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(both / F.greatest(F.size(least), F.lit(1)))


def with_next(texts: DataFrame, order: str, columns: list[str], tie: Column) -> DataFrame:
    """Each row with ``next_<column>``: values of the next row by ``order``, the first row following the last.

    ``order`` must be numeric; null counts as smallest, ties are broken by
    ``tie``. Rows are dealt into ranges of equal depth by approximate
    percentiles, and the first rows of each range are also sent to the range
    before it, so each row moves once and no range depends on another.
    """
    spark = texts.sparkSession
    at = F.coalesce(F.col(order).cast("bigint"), F.lit(-(1 << 63)))
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = texts.select(at.alias("at"))
    bounds = ids.agg(F.percentile_approx("at", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)] or [[]]
    longs = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs]).cast("array<bigint>")
    # Two short searches instead of a long one: the group of bounds, then the bound within it.
    group = F.greatest(F.size(F.filter(longs([g[0] for g in groups if g]), lambda b: b <= F.col("at"))) - 1, F.lit(0))
    inside = F.get(F.array(*[longs(g) for g in groups]), group)
    bucket = group * step + F.size(F.filter(inside, lambda b: b <= F.col("at")))
    placed = lambda d: d.withColumn("bucket", bucket)
    first = sorted((r["bucket"], r["low"]) for r in placed(ids).groupBy("bucket").agg(F.min("at").alias("low")).collect())
    before = {low: first[i - 1][0] for i, (_, low) in enumerate(first)}
    if not before:
        return texts.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    # One row per range: bounded by the number of ranges.
    heads = F.broadcast(spark.createDataFrame(list(before.items()), "low bigint, ahead int"))
    rows = placed(texts.withColumn("at", at)).join(heads, F.col("at") == F.col("low"), "left")
    own = F.struct(F.lit(0).alias("copy"), F.col("bucket").cast("int").alias("range"))
    sent = F.struct(F.lit(1).alias("copy"), F.col("ahead").alias("range"))
    rows = rows.withColumn("to", F.explode(F.when(F.col("low").isNull(), F.array(own)).otherwise(F.array(own, sent))))
    w = Window.partitionBy("to.range").orderBy("to.copy", "at", tie)
    return rows.select(*texts.columns, F.col("to.copy").alias("__copy"), *[F.lead(c).over(w).alias(f"next_{c}") for c in columns]).where("__copy = 0").drop("__copy")


def fingerprints(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S, anchors: int = ANCHORS) -> DataFrame:
    """One row per text: its fingerprint beside that of its edited text.

    The edited text replaces the last half of the characters (rounded down) by
    the first as many of the next text by ``id_col``. Returns ``id_col``,
    ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next``. Null texts count as empty. Rows with the same
    id are ordered by a hash of their text.
    """
    src = texts.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    src = src.withColumn("own", sketch(F.col("body"), k, s, anchors))
    both = with_next(src, "id", ["body", "own"], F.xxhash64("body"))
    n = F.char_length("body")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("body"), F.lit(1), n - half), F.substring(F.col("next_body"), F.lit(1), half))
    both = both.select("id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "own", "next_own")
    both = both.withColumn("edited_own", sketch(F.col("edited"), k, s, anchors))
    return both.select(
        F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("edited_own")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("edited_own"), anchors).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own"), anchors).alias("near_next"),
    )
