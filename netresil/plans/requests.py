"""From requests as they arrive (longitude, latitude) to answers with coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netresil.functions.projection import utm_to_wgs84, wgs84_to_utm
from netresil.operators.requests import apply_defaults
from netresil.operators.routing import NO_PATH, SAME_NODE, WEIGHTS, adjacency, route_coords, route_metrics, shortest_paths
from netresil.plans.impact import compare_routes, impact, snap_ends
from netresil.session import cut_lineage

ENDS = ["start_lat", "start_lon", "end_lat", "end_lon"]
FIGURES = ["distance_km", "estimated_time_mins", "avg_congestion_multiplier", "segments_count"]


def _metres(df: DataFrame, **places: tuple[str, str]) -> DataFrame:
    """Add ``<tag>x, <tag>y`` for each ``tag=(lon column, lat column)``."""
    for tag, (lon, lat) in places.items():
        x, y = wgs84_to_utm(F.col(lon), F.col(lat))
        df = df.withColumns({f"{tag}x": x, f"{tag}y": y})
    return df


def _filled(requests: DataFrame, kind: str, required: list[str]) -> DataFrame:
    for c, t in (("max_snap_dist_m", "double"), ("radius_m", "double"), ("weight_type", "string")):
        if c not in requests.columns:
            requests = requests.withColumn(c, F.lit(None).cast(t))
    return cut_lineage(apply_defaults(requests, kind, required))


def answer_routes(requests: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One answer per request: status, message, figures and ``route_coords``.

    ``requests(query_id, start_lat, start_lon, end_lat, end_lon[,
    max_snap_dist_m, weight_type])``; nulls take the defaults. A request without
    a required field, with an unknown weight, off the road or without a path
    gets status ``error`` and the reason, none is dropped. All requests of one
    weight share the rounds of one search.
    """
    asked = _filled(requests, "route", ENDS)
    reason = F.when(F.col("reason") != "ok", F.col("reason")).when(~F.col("weight_type").isin(*WEIGHTS), F.concat(F.lit("unknown weight "), "weight_type"))
    asked = asked.withColumn("refused", reason)
    good = _metres(asked.where(F.col("refused").isNull()), s=("start_lon", "start_lat"), e=("end_lon", "end_lat"))
    od = cut_lineage(good.join(snap_ends(good, nodes), "query_id").select("query_id", "weight_type", "src", "dst", "snap_message"))
    both = F.col("src").isNotNull() & F.col("dst").isNotNull()
    stay = od.where(both & (F.col("src") == F.col("dst")))
    done = stay.select("query_id", F.lit(0.0).alias("distance_km"), F.lit(0.0).alias("estimated_time_mins"), F.lit(1.0).alias("avg_congestion_multiplier"),
                       F.lit(0).cast("bigint").alias("segments_count"), F.lit(0.0).alias("cost")).join(
        route_coords(stay.select("query_id", F.lit(0).alias("seq"), F.col("src").alias("node_id")), nodes), "query_id")
    for weight in WEIGHTS:
        mine = od.where(both & (F.col("src") != F.col("dst")) & (F.col("weight_type") == weight)).select("query_id", "src", "dst")
        if mine.isEmpty():
            continue
        costs, paths = shortest_paths(mine, nodes, edges, weight, adjacency(nodes, edges, weight))
        paths = cut_lineage(paths)
        done = done.unionByName(route_metrics(paths, edges, weight).join(costs, "query_id").join(route_coords(paths, nodes), "query_id"))
    same = F.col("src") == F.col("dst")
    found = F.col("cost").isNotNull()
    return asked.select("query_id", "refused").join(od, "query_id", "left").join(done, "query_id", "left").select(
        "query_id", "src", "dst",
        F.when(F.col("refused").isNotNull() | F.col("snap_message").isNotNull(), "error").when(same, "warning").when(found, "success").otherwise("error").alias("status"),
        F.coalesce("refused", "snap_message", F.when(same, SAME_NODE).when(~found, NO_PATH)).alias("message"),
        *FIGURES, "cost", "route_coords",
    )


def simulate(requests: DataFrame, nodes: DataFrame, edges: DataFrame, population: DataFrame | None = None) -> DataFrame:
    """Key figures, normal and safe route of each request, in one row.

    ``requests(query_id, lat, lon, start_lat, start_lon, end_lat, end_lon[,
    radius_m, max_snap_dist_m])``: a failure zone and a trip. Requests without a
    required field get status ``error`` and the reason.
    """
    asked = _filled(requests, "simulate", ["lat", "lon", *ENDS])
    good = cut_lineage(_metres(asked.where("reason = 'ok'"), z=("lon", "lat"), s=("start_lon", "start_lat"), e=("end_lon", "end_lat")).withColumnsRenamed({"zx": "x", "zy": "y"}))
    figures = impact(good.select(F.col("query_id").alias("incident_id"), "x", "y", "radius_m"), nodes, edges, population).withColumnRenamed("incident_id", "query_id")
    routes = compare_routes(good.select("query_id", "x", "y", "radius_m", "sx", "sy", "ex", "ey", "max_snap_dist_m"), nodes, edges)
    status = F.when(F.col("reason") == "ok", F.lit("success")).otherwise("error")
    return asked.select("query_id", "reason").join(figures, "query_id", "left").join(routes, "query_id", "left").select(
        "query_id", status.alias("status"), F.coalesce(F.when(F.col("reason") != "ok", F.col("reason")), "message").alias("message"),
        *[c for c in figures.columns if c != "query_id"], *[c for c in routes.columns if c not in ("query_id", "message")],
    )


def place(nodes: DataFrame) -> DataFrame:
    """``node_id, lat, lon`` of every node."""
    lon, lat = utm_to_wgs84(F.col("x"), F.col("y"))
    return nodes.select("node_id", lat.alias("lat"), lon.alias("lon"))
