"""GeoJSON features and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netresil.functions import expressions as X
from netresil.functions.projection import utm_to_wgs84
from netresil.functions.rounding import round_even
from netresil.operators.graph import distinct_edges
from netresil.operators.spatial import edge_endpoints


def _feature(kind: str, coordinates: Column, properties: Column) -> Column:
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"),
        properties.alias("properties"),
    ))


def edge_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per unordered pair with lon/lat ends and display properties."""
    first = distinct_edges(edges, ["edge_key"]) if "edge_key" in edges.columns else distinct_edges(edges, ["length_m"])
    e = edge_endpoints(first, nodes)
    lon1, lat1 = utm_to_wgs84(F.col("ax"), F.col("ay"))
    lon2, lat2 = utm_to_wgs84(F.col("bx"), F.col("by"))
    return e.select(
        "src", "dst", X.feature_id("E", F.col("src"), F.col("dst")).alias("id"),
        round_even("length_m", 1).alias("length_m"), X.congestion_band(F.col("congestion_level")).alias("criticality"),
        round_even("congestion_level", 2).alias("congestion"),
        lon1.alias("lon1"), lat1.alias("lat1"), lon2.alias("lon2"), lat2.alias("lat2"),
    )


def edges_to_geojson(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One GeoJSON feature per line, ready for ``write.text``."""
    f = edge_features(nodes, edges)
    line = F.array(F.array("lon1", "lat1"), F.array("lon2", "lat2"))
    props = F.struct("id", "length_m", "criticality", "congestion")
    return f.select("src", "dst", _feature("LineString", line, props).alias("feature"))


def routes_to_geojson(routes: DataFrame) -> DataFrame:
    """Line of each route with more than one point, and its two end markers.

    ``routes(query_id, route_coords)``.
    """
    pts = F.transform("route_coords", X.to_lonlat)
    r = routes.where(F.size("route_coords") > 1).select("query_id", pts.alias("p"))
    mark = lambda colour: F.struct(F.lit(colour).alias("color"))
    empty = F.struct(F.lit(None).cast("string").alias("color"))
    return r.select("query_id", F.explode(F.array(
        F.struct(F.lit("line").alias("kind"), _feature("LineString", F.col("p"), empty).alias("feature")),
        F.struct(F.lit("start").alias("kind"), _feature("Point", F.col("p")[0], mark("#10b981")).alias("feature")),
        F.struct(F.lit("end").alias("kind"), _feature("Point", F.element_at("p", -1), mark("#ef4444")).alias("feature")),
    )).alias("f")).select("query_id", "f.kind", "f.feature")


def fit_bounds(coords: DataFrame, keys: list[str]) -> DataFrame:
    """Box around all coordinates drawn for each key: ``lon, lat`` rows."""
    return coords.groupBy(*keys).agg(
        F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat")
    )


def top_k_segments(segments: DataFrame, k: int = 8, key: str = "incident_id") -> DataFrame:
    """The k worst segments of each incident and how many more there are.

    A bounded aggregate keeps the k best per key map-side, so a key holding
    a third of all rows is never sorted in one task.
    """
    best = F.struct((-F.col("score")).alias("s"), F.col("src"), F.col("dst"))
    salted = segments.withColumn("_s", F.pmod(F.xxhash64("src", "dst"), F.lit(32)))
    part = salted.withColumn("n", F.row_number().over(Window.partitionBy(key, "_s").orderBy(best))).where(F.col("n") <= k)
    full = part.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(best))).where(F.col("rank") <= k)
    total = segments.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    return full.join(total, key).select(
        key, "rank", "src", "dst", "score", F.greatest(F.lit(0).cast("bigint"), F.col("total") - k).alias("more")
    )


def metrics_document(before: DataFrame, after: DataFrame, pixel_size_m: float) -> DataFrame:
    """Before/after document, rounded to three places."""
    part = lambda d, c, r: F.struct(round_even(d, 3).alias("component_break_density"), round_even(c, 3).alias("connectivity_ratio")).alias(r)
    b = before.select(F.col("density").alias("d0"), F.col("ratio").alias("c0"))
    a = after.select(F.col("density").alias("d1"), F.col("ratio").alias("c1"), "nodes", "edges")
    return b.join(F.broadcast(a)).select(  # two one-row tables
        part(F.col("d0"), F.col("c0"), "before_heuristic"), part(F.col("d1"), F.col("c1"), "after_heuristic"),
        "nodes", "edges", F.lit(pixel_size_m).alias("pixel_size_m"),
    )
