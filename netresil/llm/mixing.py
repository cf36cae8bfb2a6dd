"""Mixing sources to target weights by distributed prefix sums.

Every document gets a hash-random key. Within each source the documents are
dealt into ranges of that key, the words of each range are summed, the sums are
accumulated over the ranges, and only the one range in which a source's budget
ends is sorted row by row. What comes out is one cut per source, so the mixed
documents need neither a global order nor a shuffle of their texts.

Road-network records hold no running text, so the operator is general: any
table with an id, a text and a source can be mixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netresil.session import cut_lineage

#: Rows aimed at in one range of keys; a source of n rows has n / ROWS_PER_RANGE of them.
ROWS_PER_RANGE = 2048
WEIGHTS = (5, 2, 1)
_NEW = ("size", "source_size", "target", "taken")


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def random_key(seed: str, *columns: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in columns]))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """``source, source_size`` -> with ``target``: the words each source gives.

    Sources in code point order, null last, weigh ``weights`` in turn and divide
    ``share`` times all words; a target stops at ``most`` times its source, and
    what is left over is divided again by weight until none is above. That is
    solved at once: sources fill up in the order of ``most * size / weight``.
    One row per source, so the two windows over all sources are small.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), (place % len(weights) + 1).cast("int"))
    everything = Window.partitionBy(F.lit(0))
    fill = Window.partitionBy(F.lit(0)).orderBy("fills_at", "place")
    w = sources.select("source", "source_size", place.alias("place"), weight.alias("weight")).select(
        "*", (most * F.col("source_size")).alias("top"), (F.lit(share) * F.sum("source_size").over(everything)).alias("total"),
    ).withColumn("fills_at", F.col("top").cast("double") / F.col("weight"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    w = w.withColumn("left", F.col("total") - F.coalesce(F.sum("top").over(before), F.lit(0))).withColumn("open", F.sum("weight").over(after))
    w = w.withColumn("full", F.col("top").cast("double") <= F.col("left") * F.col("weight") / F.col("open"))
    used = F.coalesce(F.sum(F.when(F.col("full"), F.col("top"))).over(everything), F.lit(0))
    rest = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    target = F.when(F.col("full"), F.col("top").cast("double")).otherwise((F.col("total") - used) * F.col("weight") / rest)
    return w.select("source", "source_size", target.alias("target"))


def _cuts(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """One row per source: full ``rounds``, and where the last round ends.

    Keys below ``cut_key`` are in the last round, keys above are not; rows of
    that very key (more than one only when rows are repeated) share ``remains``
    of their ``tied`` words.
    """
    u = (F.conv(F.substring("key", 1, 8), 16, 10).cast("double")) / F.lit(float(1 << 32))
    ranged = sized.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(
        "source", "key", "size", "rest", F.floor(u * F.col("ranges")).alias("range"),
    )
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("range"))
    ending = sums.withColumn("upto", upto).where((F.col("upto") - F.col("words") < F.col("rest")) & (F.col("rest") <= F.col("upto"))).select(
        F.col("source").alias("s"), F.col("range").alias("r"), (F.col("upto") - F.col("words")).alias("below"),
    )
    rows = ranged.join(ending, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    keys = rows.groupBy("source", "key").agg(F.sum("size").alias("tied"), F.first("rest").alias("rest"), F.first("below").alias("below"))
    reached = F.col("below") + F.sum("tied").over(Window.partitionBy("source").orderBy("key"))
    cut = keys.withColumn("reached", reached).where((F.col("reached") - F.col("tied") < F.col("rest")) & (F.col("rest") <= F.col("reached"))).select(
        F.col("source").alias("s"), F.col("key").alias("cut_key"), "tied", (F.col("rest") - F.col("reached") + F.col("tied")).alias("remains"),
    )
    return plan.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias("__source"), "source_size", "target", *[F.col(c).alias(f"__{c}") for c in ("rounds", "cut_key", "tied", "remains")],
    )


def mix(
    texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, seed: str = "mix",
) -> DataFrame:
    """All columns of ``texts`` with ``size``, ``source_size``, ``target``, ``taken``.

    ``taken`` is the number of words the mix takes of a document, repeated
    rounds counted: the sum over a source is the whole part of its target, the
    document at the end of the budget is cut inside. No document gives more
    than ``most`` times its size. The key depends on the seed, the id and the
    text alone, so reruns agree; repeated rows share what falls to them evenly,
    rounded down. Null and empty texts have size 0 and give nothing. Columns
    with the new names are replaced.
    """
    keep = [c for c in texts.columns if c not in _NEW]
    key = random_key(seed, id_col, text_col)
    sized = cut_lineage(texts.select(F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key")))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    budget = F.floor("target").cast("bigint")
    rounds = F.when(F.col("source_size") > 0, budget - budget % F.col("source_size")).otherwise(0) / F.greatest("source_size", F.lit(1))
    plan = cut_lineage(
        targets(sources, weights, share, most)
        .join(sources.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s")))
        .select("source", "source_size", "target", F.ceil(F.col("rows") / ROWS_PER_RANGE).alias("ranges"), F.round(rounds).cast("bigint").alias("rounds"))
        .withColumn("rest", budget - F.col("rounds") * F.col("source_size"))
    )
    cuts = cut_lineage(_cuts(sized, plan))
    docs = texts.select(*keep, word_count(F.col(text_col)).alias("size"), key.alias("__key"))
    last = (
        F.when(F.col("__key") < F.col("__cut_key"), F.col("size"))
        .when(F.col("__key") == F.col("__cut_key"), F.expr("size * __remains div greatest(__tied, 1)"))
        .otherwise(0)
    )
    return docs.join(cuts, F.col(source_col).cast("string").eqNullSafe(F.col("__source"))).select(
        *keep, "size", "source_size", "target", (F.col("__rounds") * F.col("size") + F.coalesce(last, F.lit(0))).cast("bigint").alias("taken"),
    )
