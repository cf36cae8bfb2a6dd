"""Sampled weighted betweenness after Brandes (2001), all pivots at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netresil.operators.learning import first_by_order
from netresil.operators.pivots import dependencies
from netresil.operators.routing import adjacency
from netresil.operators.tiles import distances, place_streets, push, tiles
from netresil.session import cut_lineage

#: Streets of a network that one task may hold.
WHOLE_STREETS = 1 << 20
TIE = 1e-9  # relative: lengths summed in another order are still equal


def betweenness(nodes: DataFrame, edges: DataFrame, k: int, weight: str = "length_m", seed: int = 42) -> DataFrame:
    """``(node_id, betweenness)``, normalised and scaled up from k pivots.

    Pivots are the k smallest keyed hashes, so k >= n is exact. A network of at
    most ``WHOLE_STREETS`` goes to every task as a whole, with some of the pivots
    (see ``pivots``). On larger ones path counts flow down, and dependencies up,
    the shortest-path graphs of all pivots together, tile by tile of the plane
    (see ``tiles``).
    """
    n = nodes.count()
    k = min(k, n)
    pivots = first_by_order(nodes.select("node_id", F.xxhash64(F.lit(seed), "node_id").alias("h")), ["h", "node_id"], k)
    adj = adjacency(nodes, edges, weight)
    od = cut_lineage(pivots.select(F.col("node_id").alias("query_id"), F.col("node_id").alias("src")).distinct())
    if adj.count() <= 2 * WHOLE_STREETS:
        return _scaled(nodes, cut_lineage(dependencies(od.select("query_id"), adj, k, TIE)), n, k)
    tile = tiles(adj)
    streets = place_streets(adj, tile)
    dist = distances(od, streets, tile, k)
    d1 = dist.select("query_id", F.col("node").alias("u"), F.col("dist").alias("du"))
    d2 = dist.select("query_id", F.col("node").alias("v"), F.col("dist").alias("dv"))
    gap = F.abs(F.col("du") + F.col("w") - F.col("dv"))
    dag = cut_lineage(
        d1.join(streets, "u").join(d2, ["query_id", "v"])
        .where((F.col("w") > 0) & (gap <= TIE * (1 + F.col("dv")))).select("query_id", "u", "v", "tile", "far")
    )
    source = dist.where(F.col("query_id") == F.col("node")).select("query_id", "node", "tile", F.lit(1.0).alias("val"))
    down = dag.select("query_id", F.col("u").alias("tail"), F.col("v").alias("head"), "tile", "far", F.lit(1.0).alias("share"))
    sigma = push(down, source, k)
    su = sigma.select("query_id", F.col("node").alias("u"), F.col("val").alias("su"))
    sv = sigma.select("query_id", F.col("node").alias("v"), F.col("val").alias("sv"))
    up = cut_lineage(dag.join(su, ["query_id", "u"]).join(sv, ["query_id", "v"]).select(
        "query_id", F.col("v").alias("tail"), F.col("u").alias("head"), F.col("far").alias("tile"), F.col("tile").alias("far"),
        (F.col("su") / F.col("sv")).alias("share")))
    # every node sends its own 1 and what it was sent
    sent = push(up, dist.select("query_id", "node", "tile", F.lit(1.0).alias("val")), k)
    total = sent.where(F.col("query_id") != F.col("node")).groupBy(F.col("node").alias("node_id")).agg(F.sum(F.col("val") - 1).alias("b"))
    return _scaled(nodes, total, n, k)


def _scaled(nodes: DataFrame, total: DataFrame, n: int, k: int) -> DataFrame:
    scale = (n / k) / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return nodes.select("node_id").join(total, "node_id", "left").select(
        "node_id", (F.coalesce("b", F.lit(0.0)) * F.lit(scale)).alias("betweenness")
    )
