"""Bringing rasters, lines and points onto one grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netresil.functions.geometry import pixel_line, point_segment_distance
from netresil.functions.projection import utm_to_wgs84, wgs84_to_utm
from netresil.operators.raster import Grid, in_bounds


def _to_crs(x, y, src: int, dst: int):
    if src == dst:
        return x, y
    if src == 4326:
        return wgs84_to_utm(x, y, dst % 100)
    if dst == 4326:
        return utm_to_wgs84(x, y, src % 100)
    return wgs84_to_utm(*utm_to_wgs84(x, y, src % 100), dst % 100)


def align_bilinear(pixels: DataFrame, src: Grid, dst: Grid) -> DataFrame:
    """Resample onto another grid from the four source cells around each target.

    Weights are renormalised over the cells present; targets without any get
    no row.
    """
    cells = dst.cells(pixels.sparkSession)
    x, y = dst.x(F.col("r"), F.col("c")), dst.y(F.col("r"), F.col("c"))
    row, col = src.row_col(*_to_crs(x, y, dst.epsg, src.epsg))
    at = cells.withColumns({"fr": row, "fc": col}).where(
        (F.col("fr") > -1) & (F.col("fr") < src.height) & (F.col("fc") > -1) & (F.col("fc") < src.width)
    )
    r0, c0 = F.floor("fr"), F.floor("fc")
    wr, wc = F.col("fr") - r0, F.col("fc") - c0
    corners = F.array(*[
        F.struct((r0 + i).alias("sr"), (c0 + j).alias("sc"), ((wr if i else 1 - wr) * (wc if j else 1 - wc)).alias("w"))
        for i in (0, 1) for j in (0, 1)
    ])
    ask = at.select(F.col("r").alias("dr"), F.col("c").alias("dc"), F.explode(corners).alias("k")).select(
        "dr", "dc", F.col("k.sr").alias("r"), F.col("k.sc").alias("c"), F.col("k.w").alias("w")
    ).where(F.col("w") > 0)
    got = ask.join(pixels.select("r", "c", "value").where(F.col("value").isNotNull()), ["r", "c"])
    return got.groupBy(F.col("dr").alias("r"), F.col("dc").alias("c")).agg(
        (F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value")
    )


def align_sum(pixels: DataFrame, src: Grid, dst: Grid) -> DataFrame:
    """Counts shared out by area: what lies on the target grid is preserved.

    Both grids are axis-parallel; a source cell from another CRS is taken as
    the box around its projected corners.
    """
    corner = [(0, 0), (0, 1), (1, 0), (1, 1)]
    pts = [
        _to_crs(F.lit(src.c) + src.a * (F.col("c") + j), F.lit(src.f) + src.e * (F.col("r") + i), src.epsg, dst.epsg)
        for i, j in corner
    ]
    # in target pixel units, measured from the outer edge
    cols = [(x - dst.c) / dst.a for x, _ in pts]
    rows = [(y - dst.f) / dst.e for _, y in pts]
    box = pixels.select(
        "value", F.least(*rows).alias("ra"), F.greatest(*rows).alias("rb"), F.least(*cols).alias("ca"), F.greatest(*cols).alias("cb")
    )
    span = lambda a, b, n: F.sequence(
        F.greatest(F.lit(0).cast("bigint"), F.floor(a)), F.least(F.lit(n - 1).cast("bigint"), F.ceil(b) - 1)
    )
    keep = (F.col("rb") > 0) & (F.col("ra") < dst.height) & (F.col("cb") > 0) & (F.col("ca") < dst.width)
    cut = box.where(keep).withColumn("r", F.explode(span(F.col("ra"), F.col("rb"), dst.height))).withColumn(
        "c", F.explode(span(F.col("ca"), F.col("cb"), dst.width))
    )
    part = lambda a, b, k: (F.least(F.col(b), F.col(k) + 1) - F.greatest(F.col(a), F.col(k))) / (F.col(b) - F.col(a))
    return cut.groupBy("r", "c").agg(F.sum(F.col("value") * part("ra", "rb", "r") * part("ca", "cb", "c")).alias("value"))


def pixel_lookup(points: DataFrame, pixels: DataFrame, name: str = "value") -> DataFrame:
    """Raster value at each point's pixel, null where there is none."""
    return points.join(pixels.select("r", "c", F.col("value").alias(name)), ["r", "c"], "left")


def sample_line(lines: DataFrame, pixels: DataFrame, line_id: list[str], interior: bool = False) -> DataFrame:
    """Mean and maximum along each pixel line; 0 where no pixel is met.

    ``lines`` has ``line_id`` and ``r1, c1, r2, c2``. ``interior`` leaves out
    both ends, and lines of at most two pixels altogether.
    """
    px = pixel_line(lines.select(*line_id, "r1", "c1", "r2", "c2"))
    if interior:
        last = F.greatest(F.abs(F.col("r2") - F.col("r1")), F.abs(F.col("c2") - F.col("c1")))
        px = px.where((F.col("i") > 0) & (F.col("i") < last))
    met = px.join(pixels.select("r", "c", "value"), ["r", "c"]).groupBy(*line_id).agg(
        F.avg("value").alias("mean"), F.max("value").alias("max"), F.count(F.lit(1)).alias("met")
    )
    return lines.select(*line_id).join(met, line_id, "left").select(
        *line_id, F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("max", F.lit(0.0)).alias("max"),
        F.coalesce("met", F.lit(0)).cast("bigint").alias("met"),
    )


def rasterize_lines(segments: DataFrame, grid: Grid, width_px: float = 2.0) -> DataFrame:
    """Burn segments ``ax, ay, bx, by`` buffered by ``width_px`` pixels: set ``r, c``.

    A pixel is set when its centre lies in the buffer. Rows are followed along
    the segment, so the work is linear in its length.
    """
    reach = width_px * abs(grid.a)
    row_a, col_a = grid.row_col(F.col("ax"), F.col("ay"))
    row_b, col_b = grid.row_col(F.col("bx"), F.col("by"))
    d = reach / abs(grid.a)
    s = segments.select("ax", "ay", "bx", "by", row_a.alias("ra"), col_a.alias("ca"), row_b.alias("rb"), col_b.alias("cb"))
    lo, hi = F.least("ra", "rb") - d, F.greatest("ra", "rb") + d
    s = s.withColumn("r", F.explode(F.sequence(F.ceil(lo - 1e-9), F.floor(hi + 1e-9))))
    slope = (F.col("cb") - F.col("ca")) / F.nullif(F.col("rb") - F.col("ra"), F.lit(0.0))
    at = lambda v: F.col("ca") + (v - F.col("ra")) * slope
    near = F.greatest(F.least("ra", "rb"), F.col("r") - d)
    far = F.least(F.greatest("ra", "rb"), F.col("r") + d)
    left = F.coalesce(F.least(at(near), at(far)), F.least("ca", "cb")) - d
    right = F.coalesce(F.greatest(at(near), at(far)), F.greatest("ca", "cb")) + d
    s = s.withColumn("c", F.explode(F.sequence(F.ceil(left - 1e-9), F.floor(right + 1e-9))))
    dist = point_segment_distance(
        grid.x(F.col("r"), F.col("c")), grid.y(F.col("r"), F.col("c")), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")
    )
    return in_bounds(s.where(dist <= reach).select("r", "c"), (grid.height, grid.width)).distinct()


def burn(mask_pixels: DataFrame, grid: Grid) -> DataFrame:
    """Whole grid as 0/1."""
    return grid.cells(mask_pixels.sparkSession).join(
        mask_pixels.withColumn("hit", F.lit(1)), ["r", "c"], "left"
    ).select("r", "c", F.coalesce("hit", F.lit(0)).alias("mask"))
