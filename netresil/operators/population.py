"""People in failure zones and along edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netresil.functions import expressions as X
from netresil.functions.geometry import norm2
from netresil.operators.raster import Grid, in_bounds, percentile_or_one
from netresil.operators.resample import sample_line


#: Cell values while they are summed: exact, so sums do not depend on their order.
EXACT = "decimal(28,12)"


def row_sums(pixels: DataFrame, grid: Grid) -> DataFrame:
    """``r, c, value``: for every cell the positive values of its row up to it.

    Cells without a pixel are filled and repeated pixels added in the same
    partitions that the running sums need, so rows are shuffled once.
    """
    good = in_bounds(pixels.where(X.is_valid_positive(F.col("value"))), (grid.height, grid.width))
    every = grid.cells(pixels.sparkSession).select("r", "c", F.lit(0).cast(EXACT).alias("v"))
    both = every.union(good.select(F.col("r").cast("bigint"), F.col("c").cast("bigint"), F.col("value").cast(EXACT)))
    cells = both.repartition("r").groupBy("r", "c").agg(F.sum("v").cast(EXACT).alias("v"))
    along = Window.partitionBy("r").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    return cells.select("r", "c", F.sum("v").over(along).alias("value"))


def summed_area(rows: DataFrame) -> DataFrame:
    """``r, c, value``: the sum over all cells (r', c') with r' <= r and c' <= c, from ``row_sums``."""
    down = Window.partitionBy("c").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("r", "c", F.sum("value").over(down).alias("value"))


def _weighed(ask: DataFrame, sums: DataFrame, zone_id: str) -> DataFrame:
    """Sum of ``sign`` x value over the cells ``(zone_id, r, c, sign)``; cells before the first row or column are 0."""
    inside = ask.where((F.col("r") >= 0) & (F.col("c") >= 0))
    return inside.join(sums, ["r", "c"]).groupBy(zone_id).agg(F.sum(F.col("sign") * F.col("value")).alias("s"))


def population_in_zone(zones: DataFrame, pixels: DataFrame, grid: Grid, zone_id: str = "incident_id", shape: str = "square") -> DataFrame:
    """Sum of positive cells whose centre is in each zone's square of half-side r.

    A square covers a block of rows and columns, whose sum is four values of
    the summed-area table. ``shape="disc"`` counts the disc instead, row by
    row: each row's span is two values of its running sums. So a zone costs
    four rows, or two per raster row it meets, however many cells it covers.
    Values count to twelve decimals. Zones without a place or radius, or off
    the raster, have nobody.
    """
    half = F.col("radius_m")
    fr0, fc0 = grid.row_col(F.col("x") - half, F.col("y") - half)
    fr1, fc1 = grid.row_col(F.col("x") + half, F.col("y") + half)
    eps = 1e-9
    low = lambda a, b: F.greatest(F.lit(0).cast("bigint"), F.ceil(F.least(a, b) - eps))
    high = lambda a, b, n: F.least(F.lit(n - 1).cast("bigint"), F.floor(F.greatest(a, b) + eps))
    placed = F.col("x").isNotNull() & F.col("y").isNotNull() & half.isNotNull()
    boxes = zones.where(placed).select(
        zone_id, "x", "y", half.alias("half"), low(fr0, fr1).alias("r0"), high(fr0, fr1, grid.height).alias("r1"),
        low(fc0, fc1).alias("c0"), high(fc0, fc1, grid.width).alias("c1"),
    ).where((F.col("r0") <= F.col("r1")) & (F.col("c0") <= F.col("c1")))
    rows = row_sums(pixels, grid)
    if shape == "disc":
        sums = _weighed(_disc_spans(boxes, grid, zone_id), rows, zone_id)
    else:
        corner = lambda r, c, sign: F.struct(r.alias("r"), c.alias("c"), F.lit(sign).alias("sign"))
        r0, c0 = F.col("r0") - 1, F.col("c0") - 1
        ask = boxes.select(zone_id, F.inline(F.array(
            corner(F.col("r1"), F.col("c1"), 1), corner(r0, F.col("c1"), -1), corner(F.col("r1"), c0, -1), corner(r0, c0, 1),
        )))
        sums = _weighed(ask, summed_area(rows), zone_id)
    return zones.select(zone_id).join(sums, zone_id, "left").select(
        zone_id, F.coalesce(F.floor("s").cast("bigint"), F.lit(0).cast("bigint")).alias("population_affected")
    )


def _disc_spans(boxes: DataFrame, grid: Grid, zone_id: str) -> DataFrame:
    """Both ends of each raster row inside a disc, as cells ``(zone_id, r, c, sign)`` of running sums.

    The ends solve a quadratic in the column; being rounded, each is settled by
    testing the cells next to it.
    """
    inside = lambda c: norm2(grid.x(F.col("r"), c) - F.col("x"), grid.y(F.col("r"), c) - F.col("y")) <= F.col("half")
    zero = F.lit(0.0)
    dx, dy = grid.x(F.col("r"), zero) - F.col("x"), grid.y(F.col("r"), zero) - F.col("y")
    a = grid.a * grid.a + grid.d * grid.d
    mid = -(dx * grid.a + dy * grid.d) / a
    off = (dx * dx + dy * dy - F.col("half") * F.col("half")) / a
    # a row that touches the disc may miss it by rounding: its nearest cells are tested all the same
    reach = F.sqrt(F.greatest(mid * mid - off, zero))
    spans = boxes.withColumn("r", F.explode(F.sequence("r0", "r1"))).withColumns(
        {"from": F.floor(mid - reach) - 1, "to": F.ceil(mid + reach) + 1}
    )
    end = lambda near, step: F.coalesce(*[F.when(inside(near + step * k), near + step * k) for k in range(4)])
    ends = spans.withColumns({"lo": end(F.col("from"), 1), "hi": end(F.col("to"), -1)}).where("lo is not null and hi is not null")
    cut = ends.withColumns({"lo": F.greatest("lo", "c0"), "hi": F.least("hi", "c1")}).where("lo <= hi")
    return cut.select(zone_id, "r", F.inline(F.array(
        F.struct(F.col("hi").alias("c"), F.lit(1).alias("sign")), F.struct((F.col("lo") - 1).alias("c"), F.lit(-1).alias("sign")),
    )))


def fuse_population(edges: DataFrame, nodes: DataFrame, pixels: DataFrame) -> DataFrame:
    """Edges with population density, the congestion it suggests, and travel time.

    ``nodes(node_id, r, c)``; ends without pixel coordinates count as density 0.
    """
    a = nodes.select(F.col("node_id").alias("src"), F.col("r").alias("r1"), F.col("c").alias("c1"))
    b = nodes.select(F.col("node_id").alias("dst"), F.col("r").alias("r2"), F.col("c").alias("c2"))
    pairs = edges.select("src", "dst").distinct().join(a, "src").join(b, "dst")
    dens = sample_line(pairs, pixels, ["src", "dst"]).select("src", "dst", F.col("mean").alias("pop_density"))
    top = percentile_or_one(pixels, "value", 0.95)
    cong = X.congestion_from_density(F.col("pop_density"), F.col("top"))
    out = edges.join(dens, ["src", "dst"], "left").withColumn("pop_density", F.coalesce("pop_density", F.lit(0.0)))
    out = out.join(F.broadcast(top)).withColumn("congestion_level", cong)  # one row
    return out.withColumn("travel_time", X.travel_time(F.col("length_m"), F.col("congestion_level"), 10.0)).drop("top")
