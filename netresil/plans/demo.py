"""A scenario that is sure to work: a trip and a zone on its way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netresil.functions.projection import utm_to_wgs84
from netresil.operators.components import connected_components, largest_component_nodes
from netresil.operators.routing import demo_waypoints, shortest_paths
from netresil.session import cut_lineage


def demo_scenario(nodes: DataFrame, edges: DataFrame, radius_m: float = 500.0) -> DataFrame:
    """First to middle node of the largest component, zone at one third of the way."""
    members = largest_component_nodes(connected_components(nodes, edges))
    ways = demo_waypoints(members)
    od = cut_lineage(ways.agg(
        F.lit(0).cast("bigint").alias("query_id"), F.min_by("node_id", "pos").alias("src"), F.max_by("node_id", "pos").alias("dst")
    ))
    _, paths = shortest_paths(od, nodes, edges, "travel_time")
    n = paths.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    third = paths.join(n, "query_id").where(F.col("seq") == F.floor(F.col("n") / 3)).select("query_id", F.col("node_id").alias("zone"))
    lon, lat = utm_to_wgs84(F.col("x"), F.col("y"))
    at = lambda tag: nodes.select(
        F.col("node_id").alias(tag), F.round(lat, 6).alias(f"{tag}_lat"), F.round(lon, 6).alias(f"{tag}_lon")
    )
    return od.join(third, "query_id").join(at("src"), "src").join(at("dst"), "dst").join(at("zone"), "zone").select(
        "src", "dst", "zone", "src_lat", "src_lon", "dst_lat", "dst_lon", "zone_lat", "zone_lon",
        F.lit(radius_m).alias("radius_m"), F.lit(3000.0).alias("max_snap_dist_m"),
    )
