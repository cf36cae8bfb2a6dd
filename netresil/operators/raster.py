"""Raster algebra on pixel tables ``(keys..., r, c, value)``.

Row and column passes use range windows: a partition is one row or one column
of one raster, so its size is bounded by the raster's side.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from netresil.functions import expressions as X
from netresil.session import cut_lineage

# Channel statistics and sweep thresholds.
CHANNEL_MEAN = [0.485, 0.456, 0.406]
CHANNEL_STD = [0.229, 0.224, 0.225]
SWEEP = [0.30, 0.40, 0.50, 0.60, 0.70, 0.75, 0.80, 0.85, 0.90]


@dataclass(frozen=True)
class Grid:
    """Shape and affine transform of a raster."""

    height: int
    width: int
    a: float
    b: float
    c: float
    d: float
    e: float
    f: float
    epsg: int = 32643

    def x(self, row: Column, col: Column) -> Column:
        return F.lit(self.c) + F.lit(self.a) * (col + 0.5) + F.lit(self.b) * (row + 0.5)

    def y(self, row: Column, col: Column) -> Column:
        return F.lit(self.f) + F.lit(self.d) * (col + 0.5) + F.lit(self.e) * (row + 0.5)

    def row_col(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Fractional (row, col) measured from pixel centres."""
        det = self.a * self.e - self.b * self.d
        dx, dy = x - F.lit(self.c), y - F.lit(self.f)
        col = (F.lit(self.e) * dx - F.lit(self.b) * dy) / F.lit(det) - 0.5
        row = (F.lit(self.a) * dy - F.lit(self.d) * dx) / F.lit(det) - 0.5
        return row, col

    def cells(self, spark: SparkSession) -> DataFrame:
        n = F.lit(self.width)
        return spark.range(self.height * self.width).select(
            F.floor(F.col("id") / n).cast("bigint").alias("r"), (F.col("id") % n).alias("c")
        )


def grid_shape(pixels: DataFrame) -> tuple[int, int]:
    """(height, width): two numbers."""
    r, c = pixels.agg(F.max("r"), F.max("c")).first()
    return (r or 0) + 1, (c or 0) + 1


def in_bounds(df: DataFrame, shape: tuple[int, int]) -> DataFrame:
    return df.where(F.col("r").between(0, shape[0] - 1) & F.col("c").between(0, shape[1] - 1))


def border_guard(df: DataFrame, shape: tuple[int, int], width: str, px: int = 5) -> DataFrame:
    """Flag pixels away from the border; the width map is 0 near it."""
    inside = F.col("r").between(px, shape[0] - px - 1) & F.col("c").between(px, shape[1] - px - 1)
    return df.withColumn("inside", inside).withColumn(width, F.when(F.col("inside"), F.col(width)).otherwise(0.0))


def threshold_mask(pixels: DataFrame, t: float) -> DataFrame:
    return pixels.withColumn("mask", (F.col("value") > t).cast("int"))


def read_window(pixels: DataFrame, r0: int, r1: int, c0: int, c1: int) -> DataFrame:
    """Sub-rectangle, ends excluded; ranges reach the scan."""
    return pixels.where((F.col("r") >= r0) & (F.col("r") < r1) & (F.col("c") >= c0) & (F.col("c") < c1))


# ---- percentiles and contrast ----------------------------------------------

def exact_percentiles(df: DataFrame, value: str, ps: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Exact, linearly interpolated percentiles: columns ``p0, p1, ...`` and ``n``.

    The built-in exact percentile holds all distinct values of a group in one
    buffer. Here equal values are counted map-side, the counts are sorted over
    range partitions, and running totals across partitions locate the ranks,
    so one raster may span the whole cluster.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
    counts = cut_lineage(counts.repartitionByRange(*keys, "_v").withColumn("_p", F.spark_partition_id()))
    part = counts.groupBy(*keys, "_p").agg(F.sum("_k").alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    part = part.select(
        *keys, "_p", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"), F.sum("_s").over(whole).alias("_n")
    )
    local = Window.partitionBy("_p", *keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(part, ["_p", *keys]).withColumn("_hi", F.sum("_k").over(local) + F.col("_o"))
    ranked = ranked.withColumn("_lo", F.col("_hi") - F.col("_k"))
    aggs = [F.max("_n").alias("_n")]
    for i, p in enumerate(ps):
        at = (F.col("_n") - 1) * F.lit(float(p))
        for tag, rank in (("a", F.floor(at)), ("b", F.ceil(at))):
            aggs.append(F.max(F.when((rank >= F.col("_lo")) & (rank < F.col("_hi")), F.col("_v"))).alias(f"_{tag}{i}"))
    got = ranked.groupBy(*keys).agg(*aggs)
    out = [
        (F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * ((F.col("_n") - 1) * F.lit(float(p)) - F.floor((F.col("_n") - 1) * F.lit(float(p))))).alias(f"p{i}")
        for i, p in enumerate(ps)
    ]
    return got.select(*keys, *out, F.col("_n").cast("bigint").alias("n"))


def _with_bounds(df: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """Attach one row of bounds per raster (or one row at all)."""
    return df.join(bounds, keys, "left") if keys else df.join(F.broadcast(bounds), how="left")


def percentile_or_one(df: DataFrame, value: str, p: float = 0.95) -> DataFrame:
    """Percentile of the positive cells; 1 when there are none or it is 0."""
    got = exact_percentiles(df.where(X.is_valid_positive(F.col(value))), value, [p])
    top = got.agg(F.max("p0").alias("p0"))
    return top.select(F.coalesce(F.nullif("p0", F.lit(0.0)), F.lit(1.0)).alias("top"))


def norm01(df: DataFrame, value: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """2-98 percentile stretch of finite positives to [0, 1]; all-invalid gives 0."""
    keys = list(keys)
    b = exact_percentiles(df.where(X.is_valid_positive(F.col(value))), value, [0.02, 0.98], keys).drop("n")
    scaled = X.clip((F.col(value) - F.col("p0")) / (F.col("p1") - F.col("p0") + 1e-6), 0.0, 1.0)
    return _with_bounds(df, b, keys).withColumn(value, F.when(F.col("p0").isNull(), 0.0).otherwise(scaled)).drop("p0", "p1")


def stretch_uint8(df: DataFrame, value: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """2-98 percentile stretch to 0..255, truncated."""
    keys = list(keys)
    b = exact_percentiles(df, value, [0.02, 0.98], keys).drop("n")
    v = F.least(F.greatest(F.col(value), F.col("p0")), F.col("p1"))
    out = F.floor((v - F.col("p0")) / (F.col("p1") - F.col("p0") + 1e-6) * 255.0).cast("int")
    return _with_bounds(df, b, keys).withColumn(value, out).drop("p0", "p1")


def stretch_unit(df: DataFrame, value: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """Same to [0, 1]; where both percentiles agree the values stay as they are."""
    keys = list(keys)
    b = exact_percentiles(df, value, [0.02, 0.98], keys).drop("n")
    v = F.least(F.greatest(F.col(value), F.col("p0")), F.col("p1"))
    flat = F.col("p0") == F.col("p1")
    out = F.when(flat, F.col(value)).otherwise((v - F.col("p0")) / F.nullif(F.col("p1") - F.col("p0"), F.lit(0.0)))
    return _with_bounds(df, b, keys).withColumn(value, out).drop("p0", "p1")


def sar_db_percentile(df: DataFrame, value: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """Decibels, then the 2-98 percentile range of cells above -30."""
    keys = list(keys)
    db = df.withColumn(value, X.sar_db(F.col(value), 1e-10))
    b = exact_percentiles(db.where(F.col(value) > -30), value, [0.02, 0.98], keys).drop("n")
    v = F.least(F.greatest(F.col(value), F.col("p0")), F.col("p1"))
    return _with_bounds(db, b, keys).withColumn(value, (v - F.col("p0")) / (F.col("p1") - F.col("p0") + 1e-8)).drop("p0", "p1")


def standardize(df: DataFrame, band: str = "band", value: str = "value") -> DataFrame:
    """Z-score by the published statistics of channels 1 to 3, values 0..255."""
    mean = F.get(F.array(*[F.lit(m) for m in CHANNEL_MEAN]), F.col(band) - 1)
    std = F.get(F.array(*[F.lit(s) for s in CHANNEL_STD]), F.col(band) - 1)
    return df.withColumn(value, (F.col(value) / 255.0 - mean) / std)


def center(value: Column) -> Column:
    return (value - 0.5) / 0.5


def stack_bands(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two rasters on one grid side by side, with their mean."""
    return a.select("r", "c", F.col("value").alias("a")).join(b.select("r", "c", F.col("value").alias("b")), ["r", "c"]).withColumn(
        "mean", 0.5 * F.col("a") + 0.5 * F.col("b")
    )


def raster_stats(df: DataFrame, value: str = "value") -> DataFrame:
    v = F.col(value)
    good = X.is_valid_positive(v)
    return df.agg(
        F.count(F.lit(1)).alias("cells"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.count_if(good).alias("valid"), F.avg(F.when(good, v)).alias("mean_valid"),
        F.floor(F.coalesce(F.sum(F.when(good, v)), F.lit(0.0))).alias("total"),
        (F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"),
    )


def coverage_pct(df: DataFrame, hit: Column, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg((100.0 * F.count_if(hit) / F.count(F.lit(1))).alias("pct"))


def threshold_sweep(df: DataFrame, thresholds: Sequence[float] = tuple(SWEEP), value: str = "value") -> DataFrame:
    """Coverage at each threshold, all counted in one pass."""
    one = df.agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.count_if(F.col(value) > t) for t in thresholds]).alias("hits")
    )
    pairs = F.arrays_zip(F.array(*[F.lit(float(t)) for t in thresholds]).alias("t"), F.col("hits").alias("h"))
    pct = 100.0 * F.col("z.h") / F.col("n")
    return one.select("n", F.explode(pairs).alias("z")).select(
        F.col("z.t").alias("threshold"), pct.alias("pct"), pct.between(1.0, 10.0).alias("reasonable")
    )


# ---- neighbourhoods ---------------------------------------------------------

def _offsets(pairs) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for i, (dr, dc) in enumerate(pairs)]))


AROUND = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0)]


def neighbours8(pixels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Every ordered pair of touching set pixels: ``r, c, r2, c2``."""
    keys = list(keys)
    p = pixels.select(*keys, "r", "c")
    seek = p.withColumn("o", _offsets(AROUND)).select(
        *keys, F.col("r").alias("r2"), F.col("c").alias("c2"), (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c")
    )
    return p.join(seek, [*keys, "r", "c"])


def neighbour_count(pixels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Set pixels with the number of set pixels around them.

    Each pixel reports to its neighbours and to itself; one aggregation
    suffices, no self-join.
    """
    keys = list(keys)
    told = pixels.select(*keys, "r", "c").withColumn("o", _offsets([(0, 0), *AROUND])).select(
        *keys, (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"), (F.col("o.i") == 0).alias("own")
    )
    return told.groupBy(*keys, "r", "c").agg(
        F.count_if(~F.col("own")).alias("neighbours"), F.max("own").alias("own")
    ).where("own").drop("own")


def classify_pixels(skel: DataFrame, keys: Sequence[str] = (), lone_pixels: bool = False) -> DataFrame:
    """Endpoints and junctions; ``lone_pixels`` also takes pixels without neighbours."""
    n = F.col("neighbours")
    kind = F.when(n == 1, "endpoint").when(n >= 3, "junction")
    if lone_pixels:
        kind = kind.when(n == 0, "lone")
    return neighbour_count(skel, keys).withColumn("node_type", kind)


def breaks_per_km(skel: DataFrame, pixel_m: float, keys: Sequence[str] = ()) -> DataFrame:
    return neighbour_count(skel, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pixels"), F.count_if(F.col("neighbours") == 1).alias("endpoints"),
        (F.count_if(F.col("neighbours") == 1) / 2.0
         / F.greatest(F.count(F.lit(1)) * F.lit(pixel_m) / 1000.0, F.lit(0.001))).alias("breaks_per_km"),
    )


def focal_max(df: DataFrame, k: int, value: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """Maximum over a k x k window: a pass along rows, then along columns."""
    h = k // 2
    along = Window.partitionBy(*keys, "r").orderBy("c").rangeBetween(-h, h)
    down = Window.partitionBy(*keys, "c").orderBy("r").rangeBetween(-h, h)
    return df.withColumn(value, F.max(value).over(along)).withColumn(value, F.max(value).over(down))


def dilate(pixels: DataFrame, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """n rounds of 4-connected dilation: every pixel within n steps."""
    ball = [(dr, dc) for dr in range(-n, n + 1) for dc in range(-n, n + 1) if abs(dr) + abs(dc) <= n]
    return pixels.select(*keys, "r", "c").withColumn("o", _offsets(ball)).select(
        *keys, (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c")
    ).distinct()


def distance_to_background(mask: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Euclidean distance of each set pixel to the nearest unset one.

    ``mask`` has every pixel with ``mask`` 0 or 1. The column pass finds the
    nearest unset pixel above or below. Along a row nothing beyond the unset
    pixels on either side can be nearer, so each run of set pixels is settled
    alone: every column puts a parabola over the run, and their lower envelope
    gives the distances. A pixel is one row and one array element throughout.
    What lies below or to the right is read in falling order, since Spark goes
    through the rest of a column anew for each row of a frame that looks ahead.
    Null where a raster has no unset pixel.
    """
    keys = list(keys)
    up = Window.partitionBy(*keys, "c").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    dn = Window.partitionBy(*keys, "c").orderBy(F.col("r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    lf = Window.partitionBy(*keys, "r").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    rt = Window.partitionBy(*keys, "r").orderBy(F.col("c").desc()).rowsBetween(Window.unboundedPreceding, 0)
    r0, c0 = F.when(F.col("mask") == 0, F.col("r")), F.when(F.col("mask") == 0, F.col("c"))
    g = F.least(F.col("r") - F.last(r0, True).over(up), F.last(r0, True).over(dn) - F.col("r"))
    seen = mask.select(*keys, "r", "c", "mask").withColumn("g", g).withColumns(
        {"lo": F.last(c0, True).over(lf), "hi": F.last(c0, True).over(rt)}
    )
    runs = seen.where(F.col("mask") == 1).groupBy(*keys, "r", "lo", "hi").agg(
        F.array_sort(F.collect_list(F.struct(F.col("c").cast("bigint").alias("c"), F.col("g").cast("bigint").alias("g")))).alias("run")
    )
    sq = _run_distances(F.col("lo").cast("bigint"), F.col("hi").cast("bigint"), F.col("run.c"), F.col("run.g"))
    at = runs.select(*keys, "r", F.explode(F.arrays_zip(F.col("run.c").alias("c"), sq.alias("sq"))).alias("p"))
    return at.select(*keys, "r", F.col("p.c").alias("c"), F.sqrt(F.col("p.sq").cast("double")).alias("dist"))


@F.pandas_udf(ArrayType(LongType()))
def _run_distances(lo: pd.Series, hi: pd.Series, cols: pd.Series, heights: pd.Series) -> pd.Series:
    """Squared distances along each run; ``lo`` and ``hi`` are the unset pixels beside it, if any."""
    return pd.Series([
        _envelope(None if pd.isna(a) else int(a), None if pd.isna(b) else int(b), c, g)
        for a, b, c, g in zip(lo, hi, cols, heights)
    ], dtype=object)


def _envelope(lo: int | None, hi: int | None, cols, heights) -> list[int | None]:
    """min over u of (c - u)^2 + height(u)^2 for each column c, in whole numbers.

    ``apex`` holds the columns whose parabola is lowest somewhere, ``start``
    the first column where it is; a new one removes those it undercuts from
    their start on.
    """
    feet = [(c, int(g) ** 2) for c, g in zip(map(int, cols), heights) if g is not None and g == g]
    if lo is not None:
        feet.insert(0, (lo, 0))
    if hi is not None:
        feet.append((hi, 0))
    if not feet:
        return [None] * len(cols)
    apex, start = [], []
    for u, f in feet:
        at = int(cols[0])
        while apex:
            v, e = apex[-1]
            # the first whole column where (u, f) is strictly lower
            at = (u * u + f - v * v - e) // (2 * (u - v)) + 1
            if at > start[-1]:
                break
            apex.pop()
            start.pop()
            at = int(cols[0])
        apex.append((u, f))
        start.append(at)
    out, i = [], 0
    for c in map(int, cols):
        while i + 1 < len(start) and start[i + 1] <= c:
            i += 1
        u, f = apex[i]
        out.append((c - u) ** 2 + f)
    return out


# ---- index arithmetic -------------------------------------------------------

def flip_vertical(df: DataFrame, height: int) -> DataFrame:
    return df.withColumn("r", F.lit(height - 1) - F.col("r"))


def flip_horizontal(df: DataFrame, width: int) -> DataFrame:
    return df.withColumn("c", F.lit(width - 1) - F.col("c"))


def rotate90(df: DataFrame, width: int) -> DataFrame:
    """Counter-clockwise quarter turn."""
    return df.withColumns({"r": F.lit(width - 1) - F.col("c"), "c": F.col("r")})


def resize_nearest(df: DataFrame, shape: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """Nearest-neighbour resize; each source pixel fans out to its targets."""
    (h, w), (nh, nw) = shape, to

    def targets(i, n, m):
        lo, hi = F.ceil(i * m / F.lit(float(n))), F.ceil((i + 1) * m / F.lit(float(n))) - 1
        return F.when(hi >= lo, F.sequence(lo.cast("bigint"), hi.cast("bigint")))

    return df.withColumn("r", F.explode(targets(F.col("r"), h, nh))).withColumn("c", F.explode(targets(F.col("c"), w, nw)))


def augment(tiles: DataFrame, size: int, tile: str, seed: int = 42) -> DataFrame:
    """Flips and a quarter turn chosen per tile by keyed hash, each half the time.

    Bands of one tile share the choice, so image, radar and mask stay in step.
    """
    coin = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col(tile)), F.lit(2)) == 0)
    last = F.lit(size - 1)
    df = tiles.withColumn("c", F.when(coin(1), last - F.col("c")).otherwise(F.col("c")))
    df = df.withColumn("r", F.when(coin(2), last - F.col("r")).otherwise(F.col("r")))
    return df.withColumns({
        "r": F.when(coin(3), last - F.col("c")).otherwise(F.col("r")),
        "c": F.when(coin(3), F.col("r")).otherwise(F.col("c")),
    })


# ---- tiles ------------------------------------------------------------------

def tile_origins(length: int, size: int, overlap: int) -> list[int]:
    """Window starts along one axis, the last pulled back to the edge."""
    stride = size - overlap
    last = max(0, length - size)
    return sorted({*range(0, last + 1, stride), last})


def tile_grid(meta: DataFrame, size: int, overlap: int) -> DataFrame:
    """``raster_id, height, width`` -> ``raster_id, r0, c0``."""
    def origins(n):
        last = F.greatest(F.lit(0).cast("bigint"), n - size)
        return F.array_union(F.sequence(F.lit(0).cast("bigint"), last, F.lit(size - overlap).cast("bigint")), F.array(last))

    return meta.withColumn("r0", F.explode(origins(F.col("height").cast("bigint")))).withColumn(
        "c0", F.explode(origins(F.col("width").cast("bigint")))
    ).select("raster_id", "r0", "c0")


def _covering(i: Column, length: int, size: int, overlap: int) -> Column:
    """Origins of the windows along one axis that contain index i."""
    stride = size - overlap
    last = max(0, length - size)
    top = last // stride
    zero = F.lit(0).cast("bigint")
    lo = F.greatest(zero, F.ceil((i - (size - 1)) / F.lit(float(stride))))
    hi = F.least(F.lit(top).cast("bigint"), F.floor(i / F.lit(float(stride))))
    regular = F.when(hi >= lo, F.transform(F.sequence(lo, hi), lambda k: k * stride)).otherwise(F.array().cast("array<bigint>"))
    return F.array_union(regular, F.when(i >= last, F.array(F.lit(last).cast("bigint"))).otherwise(F.array().cast("array<bigint>")))


def _mirrored(i: Column, length: int, size: int) -> Column:
    """Where index i lands in a window longer than the axis, by reflection."""
    if length >= size or length == 1:
        return F.array(i) if length >= size else F.sequence(F.lit(0).cast("bigint"), F.lit(size - 1).cast("bigint"))
    period = 2 * (length - 1)
    turns = F.sequence(F.lit(0).cast("bigint"), F.lit(size // period + 1).cast("bigint"))
    spots = F.flatten(F.transform(turns, lambda m: F.array(m * period + i, m * period - i)))
    return F.array_distinct(F.filter(spots, lambda s: (s >= 0) & (s < size)))


def extract_tiles(pixels: DataFrame, shape: tuple[int, int], size: int, overlap: int) -> DataFrame:
    """Each pixel once per covering window: ``r0, c0, tr, tc`` and its values.

    ``tr, tc`` are positions in the window; rasters smaller than a window are
    padded by reflection.
    """
    h, w = shape
    out = pixels.withColumn("r0", F.explode(_covering(F.col("r"), h, size, overlap))).withColumn(
        "c0", F.explode(_covering(F.col("c"), w, size, overlap))
    )
    return out.withColumn("tr", F.explode(_mirrored(F.col("r") - F.col("r0"), h, size))).withColumn(
        "tc", F.explode(_mirrored(F.col("c") - F.col("c0"), w, size))
    )


def stitch(tiles: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """Mean over overlapping windows, clamped to [0, 1]; padding is cut off."""
    flat = tiles.select((F.col("r0") + F.col("tr")).alias("r"), (F.col("c0") + F.col("tc")).alias("c"), "value")
    return in_bounds(flat, shape).groupBy("r", "c").agg(X.clip(F.avg("value"), 0.0, 1.0).alias("value"))


def empty_tile_filter(tiles: DataFrame, keys: Sequence[str], min_sum: float = 0.0) -> DataFrame:
    """Tiles whose values sum to more than ``min_sum``."""
    return tiles.groupBy(*keys).agg(F.sum("value").alias("total")).where(F.col("total") > min_sum)


def road_aware_crop(mask: DataFrame, shape: tuple[int, int], size: int, min_road: int, tries: int = 20, seed: int = 42,
                    tile: str = "tile") -> DataFrame:
    """One crop window per tile: the first of ``tries`` seeded ones with enough road, else the fullest.

    Without any road in all tries the centre is taken.
    """
    h, w = shape
    tiles = mask.select(tile).distinct()
    pick = lambda k, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col(tile), F.col("t")), F.lit(n)).cast("bigint")
    crops = tiles.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))).select(
        tile, "t", pick(1, h - size + 1).alias("r0"), pick(2, w - size + 1).alias("c0")
    )
    inside = (
        (F.col("r") >= F.col("r0")) & (F.col("r") < F.col("r0") + size) & (F.col("c") >= F.col("c0")) & (F.col("c") < F.col("c0") + size)
    )
    road = mask.where(F.col("mask") == 1).join(crops, tile).where(inside).groupBy(tile, "t").agg(F.count(F.lit(1)).alias("road"))
    scored = crops.join(road, [tile, "t"], "left").withColumn("road", F.coalesce("road", F.lit(0)))
    good = F.col("road") >= min_road
    rank = F.struct(F.when(good, 0).otherwise(1), F.when(good, F.col("t")).otherwise(-F.col("road")), F.col("t"))
    best = scored.groupBy(tile).agg(F.min_by(F.struct("r0", "c0", "road"), rank).alias("b"))
    mid = lambda n: F.lit((n - size) // 2).cast("bigint")
    none = F.col("b.road") == 0
    return best.select(
        tile, F.when(none, mid(h)).otherwise(F.col("b.r0")).alias("r0"),
        F.when(none, mid(w)).otherwise(F.col("b.c0")).alias("c0"), F.col("b.road").alias("road"),
    )


def score_tiles(tiles: DataFrame, predict, keys: Sequence[str] = ("r0", "c0")) -> DataFrame:
    """Apply a caller's model tile by tile: ``predict(pandas) -> logits``.

    A tile is a bounded group (size x size pixels), so grouping is safe; the
    logistic step stays in generated code.
    """
    keys = list(keys)
    fields = ", ".join(f"{k} bigint" for k in [*keys, "tr", "tc"])

    def run(pdf):
        out = pdf[[*keys, "tr", "tc"]].copy()
        out["logit"] = predict(pdf)
        return out

    scored = tiles.groupBy(*keys).applyInPandas(run, f"{fields}, logit double")
    return scored.withColumn("value", X.sigmoid(F.col("logit"))).drop("logit")
