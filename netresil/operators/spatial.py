"""Spatial joins as equi-joins on grid cells.

No join here meets all pairs of a dense cell: nearest-node searches descend a
pyramid of occupied cells and drop those that cannot hold a neighbour, and
points at one place are folded together before they are shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from netresil.functions.geometry import norm2, point_segment_distance
from netresil.session import cut_lineage

LEAF_PLACES = 32      # stop splitting cells once no cell holds more places
FAN_BITS = 2          # each step splits a cell into 4 x 4
FINEST_CELL = 2.0 ** -10
COARSE = 64           # fine cells along one coarse cell


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(float(size))).cast("bigint")


def _around(df: DataFrame, size: float, x: str = "x", y: str = "y", reach: int = 1) -> DataFrame:
    """One row per cell of the square of cells around each point."""
    offs = F.array(*[F.lit(i).cast("bigint") for i in range(-reach, reach + 1)])
    return (
        df.withColumn("cx", F.explode(F.transform(offs, lambda o: o + _cell(F.col(x), size))))
        .withColumn("cy", F.explode(F.transform(offs, lambda o: o + _cell(F.col(y), size))))
    )


def _pyramid_sizes(places: DataFrame, top: float) -> list[float]:
    """Cell sizes from ``top`` down to one whose cells hold few places.

    One aggregate per level; the driver sees a single number each time.
    """
    sizes = [top]
    while sizes[-1] > FINEST_CELL:
        fullest = places.groupBy(_cell(F.col("x"), sizes[-1]), _cell(F.col("y"), sizes[-1])).count().agg(
            F.max("count")
        ).first()[0]
        if fullest is None or fullest <= LEAF_PLACES:
            break
        sizes.append(sizes[-1] / 2**FAN_BITS)
    return sizes


def _box_near(px: Column, py: Column) -> Column:
    """Distance from a point to the box of a cell's places."""
    zero = F.lit(0.0)
    dx = F.greatest(F.col("x0") - px, zero, px - F.col("x1"))
    dy = F.greatest(F.col("y0") - py, zero, py - F.col("y1"))
    return norm2(dx, dy)


def _box_far(px: Column, py: Column) -> Column:
    dx = F.greatest(F.abs(px - F.col("x0")), F.abs(px - F.col("x1")))
    dy = F.greatest(F.abs(py - F.col("y0")), F.abs(py - F.col("y1")))
    return norm2(dx, dy)


def nearest_nodes(points: DataFrame, nodes: DataFrame, k: int = 1, max_dist: float | None = None) -> DataFrame:
    """The k nearest nodes of every point, ties by node id.

    ``points(point_id, x, y)``, ``nodes(node_id, x, y)`` ->
    ``(point_id, node_id, dist, rank)``. Points without a node within
    ``max_dist`` give no row. Each step keeps, per place, only the cells whose
    nearest possible node is not beyond the k-th farthest possible one, so the
    search is exact and touches a handful of cells however dense the data.
    """
    spots = points.groupBy("x", "y").agg(F.count(F.lit(1)).alias("copies")).select(
        F.col("x").alias("px"), F.col("y").alias("py")
    )
    nodes = nodes.select("node_id", "x", "y")
    # written once: every level below reads the folded places, not the source
    places = cut_lineage(nodes.groupBy("x", "y").agg(F.count(F.lit(1)).alias("held")))
    if max_dist is None:
        ext = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        ext2 = nodes.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        if ext[0] is None or ext2[0] is None:
            top = 1.0
        else:
            span = max(
                max(ext[1], ext2[1]) - min(ext[0], ext2[0]), max(ext[3], ext2[3]) - min(ext[2], ext2[2]), 1.0
            )
            top = 2.0 ** math.ceil(math.log2(span))
    else:
        top = 2.0 ** math.ceil(math.log2(max(max_dist, 1e-3)))
    sizes = _pyramid_sizes(places, top)
    # cells of the finest level once; each coarser level is rolled up from the one below it
    box = [F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.sum("held").alias("held")]
    finest = cut_lineage(places.groupBy(_cell(F.col("x"), sizes[-1]).alias("cx"), _cell(F.col("y"), sizes[-1]).alias("cy")).agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.sum("held").alias("held")))
    level = {sizes[-1]: finest}
    for coarse, fine in zip(sizes[-2::-1], sizes[:0:-1]):
        up = lambda c: F.floor(F.col(c) / F.lit(float(2**FAN_BITS))).cast("bigint")
        level[coarse] = cut_lineage(level[fine].groupBy(up("cx").alias("cx"), up("cy").alias("cy")).agg(*box))

    here = [F.col("px"), F.col("py")]
    found = None
    for size in sizes:
        cells = level[size]
        if found is None:
            looked = _around(spots, size, "px", "py")
        else:
            kids = F.array(*[F.lit(i).cast("bigint") for i in range(2**FAN_BITS)])
            looked = (
                found.withColumn("cx", F.explode(F.transform(kids, lambda o: F.col("cx") * 2**FAN_BITS + o)))
                .withColumn("cy", F.explode(F.transform(kids, lambda o: F.col("cy") * 2**FAN_BITS + o)))
            )
        met = looked.join(cells, ["cx", "cy"]).select(
            "px", "py", "cx", "cy", "held", _box_near(*here).alias("near"), _box_far(*here).alias("far")
        )
        if max_dist is not None:
            met = met.where(F.col("near") <= max_dist)
        w = Window.partitionBy("px", "py")
        total = F.sum("held").over(w.orderBy("far", "cx", "cy").rowsBetween(Window.unboundedPreceding, 0))
        reach = F.min(F.when(F.col("total") >= k, F.col("far"))).over(w)
        found = (
            met.withColumn("total", total)
            .withColumn("reach", reach)
            .where(F.col("reach").isNull() | (F.col("near") <= F.col("reach")))
            .select("px", "py", "cx", "cy")
        )
    # every node of a place is as near as its first k, so at most k are sent on
    firsts = nodes.groupBy("x", "y").agg(F.min("node_id").alias("node_id")) if k == 1 else (
        nodes.withColumn("n", F.row_number().over(Window.partitionBy("x", "y").orderBy("node_id")))
        .where(F.col("n") <= k).drop("n")
    )
    leaf = firsts.withColumns({"cx": _cell(F.col("x"), sizes[-1]), "cy": _cell(F.col("y"), sizes[-1])})
    dist = norm2(F.col("px") - F.col("x"), F.col("py") - F.col("y"))
    pairs = found.join(leaf, ["cx", "cy"]).select("px", "py", "node_id", dist.alias("dist"))
    if max_dist is not None:
        pairs = pairs.where(F.col("dist") <= max_dist)
    if k == 1:
        best = pairs.groupBy("px", "py").agg(F.min(F.struct("dist", "node_id")).alias("b")).select(
            "px", "py", "b.node_id", "b.dist", F.lit(1).alias("rank")
        )
    else:
        order = Window.partitionBy("px", "py").orderBy("dist", "node_id")
        best = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return points.select("point_id", F.col("x").alias("px"), F.col("y").alias("py")).join(
        best, ["px", "py"]
    ).select("point_id", "node_id", "dist", "rank")


def snap(points: DataFrame, nodes: DataFrame, max_dist: float | None = None) -> DataFrame:
    """Nearest node of every point, or an error status beyond its limit.

    The limit is ``max_dist``, or each point's own ``max_snap_dist_m`` where
    that is not given.
    """
    if max_dist is None:
        points = points.withColumn("limit", F.col("max_snap_dist_m"))
        reach = points.agg(F.max("limit")).first()[0] or 0.0
    else:
        points, reach = points.withColumn("limit", F.lit(float(max_dist))), max_dist
    hit = nearest_nodes(points, nodes, 1, reach)
    # Fixed value: the message of a request off the road.
    text = F.concat(F.lit("No road found within "), F.format_string("%.0f", F.col("limit")), F.lit(" m of your location. Try a point closer to a road."))
    near = points.select("point_id", "limit").join(hit.drop("rank"), "point_id", "left").withColumn("near", F.coalesce(F.col("dist") <= F.col("limit"), F.lit(False)))
    return near.select(
        "point_id", F.when(F.col("near"), F.col("node_id")).alias("node_id"), F.when(F.col("near"), F.col("dist")).alias("dist"),
        F.when(F.col("near"), F.lit("ok")).otherwise(F.lit("error")).alias("status"),
        F.when(~F.col("near"), text).alias("message"),
    )


def coverage(points: DataFrame, nodes: DataFrame, within: float = 500.0) -> DataFrame:
    """Distance from named places to the nearest node, however far."""
    return nearest_nodes(points, nodes, 1).select(
        "point_id", "dist", (F.col("dist") < within).alias("covered")
    )


def _radius_class(radius: Column) -> Column:
    """Power-of-two size class: 2^class is at least the radius."""
    return F.ceil(F.log2(F.greatest(radius, F.lit(1e-3)))).cast("int")


def _classes_of(zones: DataFrame) -> list[int]:
    """Distinct size classes present: a few dozen at the very most."""
    return sorted(r[0] for r in zones.select(_radius_class(F.col("radius_m")).alias("k")).distinct().collect())


def _zone_cells(zones: DataFrame) -> DataFrame:
    """The 3 x 3 cells of a zone's own size class."""
    offs = F.array(*[F.lit(i).cast("bigint") for i in (-1, 0, 1)])
    size = F.pow(F.lit(2.0), F.col("cls"))
    z = zones.withColumn("cls", _radius_class(F.col("radius_m")))
    return z.withColumn(
        "cx", F.explode(F.transform(offs, lambda o: o + F.floor(F.col("x") / size).cast("bigint")))
    ).withColumn("cy", F.explode(F.transform(offs, lambda o: o + F.floor(F.col("y") / size).cast("bigint"))))


def _each_class(classes: list[int]) -> Column:
    return F.explode(F.array(*[F.lit(c) for c in classes]))


def within_radius(zones: DataFrame, nodes: DataFrame, zone_id: str = "incident_id") -> DataFrame:
    """``(zone, node_id, dist)`` for every node inside a zone."""
    return _inside(zones, nodes.select("node_id", "x", "y"), zone_id).select(zone_id, "node_id", "dist")


def _inside(zones: DataFrame, nodes: DataFrame, zone_id: str) -> DataFrame:
    """All columns of ``nodes`` for every one inside a zone, with ``zone_id`` and ``dist``.

    Merged on purpose: the planner's estimate leaves out that a zone becomes
    nine rows, so it would broadcast, through the driver, far more than it allows.
    """
    classes = _classes_of(zones) or [0]
    z = _zone_cells(zones).select(zone_id, "cls", "cx", "cy", F.col("x").alias("zx"), F.col("y").alias("zy"), "radius_m")
    size = F.pow(F.lit(2.0), F.col("cls"))
    n = nodes.withColumn("cls", _each_class(classes)).withColumns(
        {"cx": F.floor(F.col("x") / size).cast("bigint"), "cy": F.floor(F.col("y") / size).cast("bigint")}
    )
    dist = norm2(F.col("x") - F.col("zx"), F.col("y") - F.col("zy"))
    return n.join(z.hint("merge"), ["cls", "cx", "cy"]).withColumn("dist", dist).where(
        F.col("dist") <= F.col("radius_m")
    ).select(zone_id, *nodes.columns, "dist")


def nodes_in_zone(zones: DataFrame, nodes: DataFrame, zone_id: str = "incident_id") -> DataFrame:
    """Node count per zone, zero included; places are counted before the join."""
    places = nodes.groupBy("x", "y").agg(F.count(F.lit(1)).alias("held"))
    counted = _inside(zones, places, zone_id).groupBy(zone_id).agg(
        F.sum("held").cast("bigint").alias("nodes_in_zone")
    )
    return zones.select(zone_id).join(counted, zone_id, "left").select(
        zone_id, F.coalesce("nodes_in_zone", F.lit(0).cast("bigint")).alias("nodes_in_zone")
    )


def edge_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Attach both ends' coordinates as ``ax, ay, bx, by``."""
    a = nodes.select(F.col("node_id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = nodes.select(F.col("node_id").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return edges.join(a, "src").join(b, "dst")


def _column_span(col: Column, size: Column) -> tuple[Column, Column]:
    """First and last row of cells that a segment (with ``_x0, _x1, _slope``) runs through within a column of cells."""
    y_at = lambda v: F.col("ay") + (v - F.col("ax")) * F.col("_slope")
    left, right = F.greatest("_x0", col * size), F.least("_x1", (col + 1) * size)
    lo_y = F.coalesce(F.least(y_at(left), y_at(right)), F.least("ay", "by"))
    hi_y = F.coalesce(F.greatest(y_at(left), y_at(right)), F.greatest("ay", "by"))
    slack = F.lit(1e-6)
    return F.floor((lo_y - slack) / size).cast("bigint"), F.floor((hi_y + slack) / size).cast("bigint")


def _cells_between(lo: Column, hi: Column, within: str | None = None) -> Column:
    """One row per cell from ``lo`` to ``hi``; ``within`` names the column of a coarse cell, then only those inside it."""
    if within is not None:
        lo, hi = F.greatest(lo, F.col(within) * COARSE), F.least(hi, F.col(within) * COARSE + COARSE - 1)
    return F.explode(F.when(lo <= hi, F.sequence(lo, hi)))


def _segment_columns(segments: DataFrame, size: Column, x: str, within: str | None = None) -> DataFrame:
    """Columns of cells that a segment crosses."""
    at = lambda c: F.floor(F.col(c) / size).cast("bigint")
    return segments.withColumn(x, _cells_between(at("_x0"), at("_x1"), within))


def segments_within(zones: DataFrame, segments: DataFrame, zone_id: str = "incident_id") -> DataFrame:
    """Every (zone, segment) whose distance is at most the zone's radius.

    ``segments`` carries ``src, dst, ax, ay, bx, by`` and is unique by
    (src, dst). Zones are met on the grid of their own radius class, nine cells
    each. A segment is first laid on a grid 64 times as coarse, and on the fine
    one only inside coarse cells that hold a zone of the class. A pair that
    meets in several cells is kept in the first of them, so pairs need no
    deduplication.
    """
    classes = _classes_of(zones) or [0]
    keep = [c for c in segments.columns]
    size = F.pow(F.lit(2.0), F.col("cls"))
    east, north = (F.col(c) - F.floor(F.col(v) / size).cast("bigint") + 1 for c, v in (("cx", "x"), ("cy", "y")))
    z = _zone_cells(zones).select(
        zone_id, "cls", "cx", "cy", F.col("x").alias("zx"), F.col("y").alias("zy"), "radius_m",
        F.element_at(F.array(*[F.lit(1 << k) for k in range(9)]), (3 * east + north + 1).cast("int")).alias("place"),
    )
    up = lambda c: F.floor(F.col(c) / F.lit(float(COARSE))).cast("bigint")
    held = z.select("cls", up("cx").alias("kx"), up("cy").alias("ky")).distinct()
    # worked out before a segment is laid on cells, which keeps the code run per cell short
    sized = segments.withColumns({
        "_x0": F.least("ax", "bx"), "_x1": F.greatest("ax", "bx"),
        "_slope": (F.col("by") - F.col("ay")) / F.nullif(F.col("bx") - F.col("ax"), F.lit(0.0)),
    }).withColumn("cls", _each_class(classes)).withColumn("_size", size)
    size = F.col("_size")
    # cells column by column, so their number is linear in a segment's length
    wide = _segment_columns(sized, size * COARSE, "kx")
    near = wide.withColumn("ky", _cells_between(*_column_span(F.col("kx"), size * COARSE))).join(held, ["cls", "kx", "ky"], "left_semi")
    s = _first_met(_segment_columns(near, size, "cx", "kx"), size).select(*keep, "cls", "cx", "cy", "met")
    dist = point_segment_distance(*[F.col(c) for c in ("zx", "zy", "ax", "ay", "bx", "by")])
    return (
        s.join(z.hint("merge"), ["cls", "cx", "cy"])  # as in _inside
        .where(F.col("met").bitwiseAND(F.col("place")) != 0)
        .withColumn("dist", dist)
        .where(F.col("dist") <= F.col("radius_m"))
        .select(zone_id, *keep, "dist")
    )


def _first_met(columns: DataFrame, size: Column) -> DataFrame:
    """The cells ``cy`` of a segment's columns ``cx``, each with ``met``: for which of the nine places around a zone it
    is the first cell that the segment runs through.

    One bit per place, so pairs only look it up. What the segment covers of a
    column and of the two before it is worked out once per column, and a cell
    only compares whole numbers: the code of both stays short enough for the
    JVM to compile.
    """
    spans = {}
    for back in range(3):
        col = F.col("cx") - back
        reached = col >= F.floor(F.col("_x0") / size).cast("bigint")  # null before the segment's first column
        spans[f"_lo{back}"], spans[f"_hi{back}"] = (F.when(reached, v) for v in _column_span(col, size))
    cells = columns.withColumns(spans).withColumn("cy", _cells_between(F.col("_lo0"), F.col("_hi0"), "ky"))
    # bits for the three rows of one column of places: the zone's lowest row, or the segment's
    here = F.when(F.col("cy") == F.col("_lo0"), 7).otherwise(1)
    met = here
    for back in (1, 2):
        lo, hi, missed = F.col(f"_lo{back}"), F.col(f"_hi{back}"), F.lit(0)
        for k in range(3):
            oy = F.col("cy") - (k - 1)
            missed = missed.bitwiseOR(F.when((lo <= oy + 1) & (hi >= oy - 1), 0).otherwise(1 << k))
        here = here.bitwiseAND(missed)
        met = met.bitwiseOR(F.shiftleft(here, 3 * back))
    return cells.withColumn("met", met)


def distance_pairs(points: DataFrame, radius: float, keys: list[str] | None = None) -> DataFrame:
    """Unordered pairs at most ``radius`` apart: ``(ni, nj, gap)`` with ni < nj.

    Since the pairs are unordered, each point looks at its own cell and at four
    of the eight around it; the other four look at it. Within its own cell a
    pair is met from both sides and kept from one.
    """
    keys = keys or []
    p = points.select(*keys, F.col("node_id"), "x", "y").withColumns({"ox": _cell(F.col("x"), radius), "oy": _cell(F.col("y"), radius)})
    ahead = F.array(*[F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(j).cast("bigint").alias("j")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    a = p.withColumn("o", F.explode(ahead)).select(
        *keys, (F.col("ox") + F.col("o.i")).alias("cx"), (F.col("oy") + F.col("o.j")).alias("cy"), ((F.col("o.i") == 0) & (F.col("o.j") == 0)).alias("own"),
        F.col("node_id").alias("na"), F.col("x").alias("xa"), F.col("y").alias("ya"),
    )
    b = p.select(*keys, F.col("ox").alias("cx"), F.col("oy").alias("cy"), F.col("node_id").alias("nb"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    first = F.col("na") < F.col("nb")
    pick = lambda u, v: F.when(first, F.col(u)).otherwise(F.col(v))
    gap = norm2(F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb"))
    return (
        a.join(b, [*keys, "cx", "cy"])
        .where((F.col("na") != F.col("nb")) & (~F.col("own") | first))
        .withColumn("gap", gap)
        .where(F.col("gap") <= radius)
        .select(*keys, pick("na", "nb").alias("ni"), pick("nb", "na").alias("nj"), "gap",
                pick("xa", "xb").alias("xi"), pick("ya", "yb").alias("yi"), pick("xb", "xa").alias("xj"), pick("yb", "ya").alias("yj"))
    )


def knn_in_component(points: DataFrame, nodes: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """k nearest among the nodes of a component (semi join, then search)."""
    return nearest_nodes(points, nodes.join(members, "node_id", "left_semi"), k)


def random_near(points: DataFrame, nodes: DataFrame, members: DataFrame, k: int = 50, seed: int = 7) -> DataFrame:
    """One of the k nearest member nodes of each point, chosen by a keyed hash.

    ``point_id, node_id, status``; only members are searched, so every point
    gets one. Where there is no member at all, the row stays with a null node
    and status ``error``.
    """
    near = knn_in_component(points, nodes, members, k)
    pick = F.struct(F.xxhash64(F.lit(seed), "point_id", "node_id").alias("h"), "node_id")
    chosen = near.groupBy("point_id").agg(F.min(pick).alias("p"))
    return points.select("point_id").distinct().join(chosen, "point_id", "left").select(
        "point_id", F.col("p.node_id").alias("node_id"), F.when(F.col("p").isNull(), "error").otherwise("success").alias("status"))
