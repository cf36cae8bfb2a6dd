"""Tile catalogs: pairing files by name, checking alignment, counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netresil.operators.routing import positions
from netresil.session import cut_lineage

# Name tokens that differ between image and vector files.
IMAGE_TOKENS = ["PS-RGB", "PS-MS", "PAN", "MS", "RGB-PanSharpen"]
VECTOR_TOKENS = ["geojson_roads_speed", "geojson_roads", "geojson"]


def pending_tiles(catalog: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return catalog.join(done, keys, "left_anti")


def match_tiles(images: DataFrame, masks: DataFrame, sar: DataFrame | None = None) -> DataFrame:
    """Images with their mask, and their radar tile if asked for, by file stem."""
    m = masks.select("city", F.regexp_replace("stem", "_mask$", "").alias("stem"), F.col("path").alias("mask_path"))
    out = images.select("city", "stem", F.col("path").alias("image_path")).join(m, ["city", "stem"])
    if sar is not None:
        s = sar.select("city", F.regexp_replace("stem", "_sar$", "").alias("stem"), F.col("path").alias("sar_path"))
        out = out.join(s, ["city", "stem"])
    return out


def _parts(stem: Column) -> Column:
    return F.split(F.replace(stem, F.lit("-"), F.lit("_")), "_")


def fuzzy_match_tiles(images: DataFrame, vectors: DataFrame) -> DataFrame:
    """Best vector file of each image: ``stem, vector, priority``.

    Priorities: 0 exact; 1-15 token substitutions; 21-24 the last one to four
    name parts contained; 30 and up the last numeric part at the end. Ties by
    vector name. A name that contains the last two parts or more contains the
    last one too, so 21 is met whenever 22 to 24 are, and is looked for alone.
    Every strategy is an equi-join on single name parts: a part holds no
    separator, so it lies inside one run of a vector's name between two of
    them. Vectors are compared by their position in the order of names.
    """
    img = images.select("stem").distinct()
    # written: five reads
    vec = cut_lineage(positions(vectors.select(F.col("stem").alias("vector")).where(F.col("stem").isNotNull()).distinct(), "vector"))
    exact = img.join(vec, F.col("stem") == F.col("vector")).select("stem", "pos", F.lit(0).alias("priority"))
    swaps = F.array(*[
        F.struct(F.lit(1 + i * len(VECTOR_TOKENS) + j).alias("priority"), F.replace(F.col("stem"), F.lit(a), F.lit(b)).alias("vector"))
        for i, a in enumerate(IMAGE_TOKENS) for j, b in enumerate(VECTOR_TOKENS)
    ])
    # a name without the token stays as it is, which is the exact match
    swapped = img.select("stem", F.explode(swaps).alias("s")).where(F.col("s.vector") != F.col("stem")).select("stem", "s.vector", "s.priority").join(
        vec, "vector").select("stem", "pos", "priority")
    last = img.select("stem", F.element_at(_parts(F.col("stem")), -1).alias("part"))
    lengths = F.broadcast(last.agg(F.sort_array(F.collect_set(F.length("part"))).alias("lens")))  # at most the name length
    contained = last.join(contained_parts(vec, lengths), "part").select("stem", "pos", F.lit(21).alias("priority"))
    digits = img.select("stem", F.posexplode(F.reverse(_parts(F.col("stem")))).alias("k", "part")).where(F.col("part").rlike("^[0-9]+$"))
    ended = digits.join(digit_tails(vec), "part").select("stem", "pos", (F.col("k") + 30).alias("priority"))
    every = exact.unionByName(swapped).unionByName(contained).unionByName(ended)
    best = every.groupBy("stem").agg(F.min(F.struct("priority", "pos")).alias("b")).select("stem", "b.pos", "b.priority")
    return best.join(vec, "pos").select("stem", "vector", "priority")


def contained_parts(vec: DataFrame, lengths: DataFrame) -> DataFrame:
    """First vector that contains each text without separators of the asked lengths: ``part, pos``.

    Names share most of their runs, so each run is taken apart once.
    """
    runs = vec.select("pos", F.explode(_parts(F.col("vector"))).alias("run")).groupBy("run").agg(F.min("pos").alias("pos"))
    sized = runs.join(lengths).withColumn("len", F.explode("lens")).where(F.length("run") >= F.col("len"))
    windows = sized.withColumn("at", F.explode(F.sequence(F.lit(1), F.length("run") - F.col("len") + 1)))
    return windows.groupBy(F.substring(F.col("run"), F.col("at"), F.col("len")).alias("part")).agg(F.min("pos").alias("pos"))


def digit_tails(vec: DataFrame) -> DataFrame:
    """First vector that ends with each numeric text: ``part, pos``."""
    run = vec.select("pos", F.element_at(_parts(F.col("vector")), -1).alias("run"))
    tails = run.withColumn("at", F.explode(F.sequence(F.lit(1), F.length("run")))).select(
        "pos", F.substring(F.col("run"), F.col("at"), F.length("run")).alias("part"))
    return tails.where(F.col("part").rlike("^[0-9]+$")).groupBy("part").agg(F.min("pos").alias("pos"))


def check_alignment(sets: DataFrame) -> DataFrame:
    """Every mismatch between the three rasters of each tile.

    ``sets`` has ``stem`` and structs ``opt, sar, msk`` with ``height, width,
    epsg, t`` (six coefficients) and ``b`` (four bounds), and ``sar_sum``.
    """
    def off(a, b, tol):
        return F.exists(F.zip_with(a, b, lambda x, y: F.abs(x - y) >= tol), lambda v: v)

    checks = []
    for name in ("sar", "msk"):
        o, s = F.col("opt"), F.col(name)
        checks += [
            F.when((o["height"] != s["height"]) | (o["width"] != s["width"]), F.lit(f"dim {name}")),
            F.when(o["epsg"] != s["epsg"], F.lit(f"crs {name}")),
            F.when(off(o["t"], s["t"], 1e-3), F.lit(f"transform {name}")),
            F.when(off(o["b"], s["b"], 1.0), F.lit(f"bounds {name}")),
        ]
    checks += [
        F.when(F.abs(F.abs(F.col("opt.t")[0]) - F.abs(F.col("sar.t")[0])) > 0.5, F.lit("pixel size sar")),
        F.when(F.col("sar_sum") == 0, F.lit("sar all zeros")),
    ]
    return sets.select("stem", F.array_compact(F.array(*checks)).alias("failures")).withColumn("ok", F.size("failures") == 0)


def prep_tally(status: DataFrame, kinds: list[str]) -> DataFrame:
    return status.groupBy("city").pivot("status", kinds).count().na.fill(0)


def first_present_band(available: DataFrame, priority: list[str], key: str = "scene") -> DataFrame:
    """First band of the priority list each scene has; null if none."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("band"))
    ranked = available.withColumn("rank", F.when(rank > 0, rank))
    return ranked.groupBy(key).agg(F.min_by("band", "rank").alias("band"))


def axis_window(axis: DataFrame, lo: float, hi: float, key: str = "axis") -> DataFrame:
    """Index range of each axis covering [lo, hi] with one cell of margin.

    ``axis(key, idx, coord)``, coordinates rising or falling. Ends are
    ``start`` (included) and ``stop`` (excluded); ``flip`` marks rising axes,
    which run bottom-up.
    """
    g = axis.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("idx") == 0, F.col("coord"))).alias("c0"), F.max(F.when(F.col("idx") == 1, F.col("coord"))).alias("c1"),
        F.count_if(F.col("coord") < lo).alias("below"), F.count_if(F.col("coord") <= hi).alias("upto"),
        F.count_if(F.col("coord") > hi).alias("above"), F.count_if(F.col("coord") >= lo).alias("from_lo"),
    )
    up = F.col("c1") > F.col("c0")
    zero = F.lit(0).cast("bigint")
    start = F.greatest(zero, F.when(up, F.col("below")).otherwise(F.col("above")) - 1)
    stop = F.least(F.col("n"), F.when(up, F.col("upto")).otherwise(F.col("from_lo")) + 1)
    return g.select(key, start.alias("start"), stop.alias("stop"), up.alias("flip"))
