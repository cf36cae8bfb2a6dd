"""Road mask to healed network, and training pairs for the gap model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netresil.operators import graph as GR
from netresil.operators import healing as HL
from netresil.operators import skeleton as SK
from netresil.operators.components import break_density, connected_components, joined_components, quality_report
from netresil.operators.raster import Grid, border_guard, distance_to_background
from netresil.session import cut_lineage


def mask_to_graph(mask: DataFrame, grid: Grid, lone_pixels: bool = False, count_pixels: bool = True):
    """``mask(r, c, mask)`` -> skeleton, nodes with map coordinates, edges."""
    skel = SK.thin(mask.where(F.col("mask") == 1))
    nodes, edges = SK.trace_edges(skel, grid.width, abs(grid.a), lone_pixels, count_pixels)
    nodes = nodes.withColumns({"x": grid.x(F.col("r"), F.col("c")), "y": grid.y(F.col("r"), F.col("c"))})
    return skel, cut_lineage(nodes), cut_lineage(edges)


def heal_by_radar(mask: DataFrame, vv: DataFrame, vh: DataFrame, grid: Grid) -> dict[str, DataFrame]:
    """Two healing passes, the second on the first one's output, and the report.

    Components are worked out once; a pass joins those its bridges meet.
    """
    mask = cut_lineage(mask)
    px = abs(grid.a)
    skel, nodes, edges = mask_to_graph(mask, grid, lone_pixels=True, count_pixels=False)
    radar = cut_lineage(HL.radar_corridor(vv, vh))
    widths = cut_lineage(distance_to_background(mask))

    def stage(name, parts, e):
        one = break_density(parts, e)
        return one.select(F.lit(name).alias("stage"), "components", "km", "density")

    parts = cut_lineage(connected_components(nodes, edges))
    stages = stage("before", parts, edges)
    bridges = None
    for i, threshold in enumerate(HL.WCS["passes"], 1):
        dead = nodes.join(GR.terminals(edges), "node_id", "left_semi")
        feats = HL.gap_features(dead, skel, widths, radar, HL.WCS["buffer_m"] / px)
        new = cut_lineage(HL.heal_wcs(nodes, edges, feats, threshold, px, parts).withColumn("pass", F.lit(i)))
        bridges = new if bridges is None else bridges.unionByName(new)
        edges = cut_lineage(GR.add_edges(edges, new.drop("pass"), "healed_wcs"))
        parts = cut_lineage(joined_components(parts, new))
        stages = stages.unionByName(stage(f"pass {i}", parts, edges))
    return {"nodes": nodes, "edges": edges, "bridges": bridges, "report": quality_report(stages)}


def heal_by_sight(mask: DataFrame, prob: DataFrame, grid: Grid) -> dict[str, DataFrame]:
    """One pass on geometry and line of sight."""
    skel, nodes, edges = mask_to_graph(cut_lineage(mask), grid)
    new = cut_lineage(HL.heal_optical(nodes, edges, prob))
    return {"nodes": nodes, "edges": GR.add_edges(edges, new, "healed_baseline"), "bridges": new}


def training_pairs(mask: DataFrame, vv: DataFrame, vh: DataFrame, grid: Grid) -> DataFrame:
    """Every pair of dead ends within reach with features, outcome and label."""
    mask = cut_lineage(mask)
    px = abs(grid.a)
    shape = (grid.height, grid.width)
    road = mask.where(F.col("mask") == 1).select("r", "c")
    skel = SK.thin(road)
    ends = SK.neighbour_count(skel).where(F.col("neighbours") == 1).select(
        (F.col("r") * grid.width + F.col("c")).alias("node_id"), "r", "c"
    )
    radar = cut_lineage(HL.radar_corridor(vv, vh, HL.LABELS["dilation"]))
    wide = distance_to_background(mask).withColumn("dist", F.col("dist") * 2.0 * px)
    widths = cut_lineage(border_guard(wide, shape, "dist", HL.LABELS["border_px"]).drop("inside"))
    pairs = HL.gap_features(cut_lineage(ends), skel, widths, radar, HL.LABELS["buffer_m"] / px)
    return HL.label_gaps(cut_lineage(pairs), skel, road, shape, widths)
