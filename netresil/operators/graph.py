"""Edge tables: cleaning, degrees, core numbers, criticality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netresil.functions import expressions as X
from netresil.session import Rounds, cut_lineage


def normalize_edges(edges: DataFrame, speed: float = X.SPEED_MS) -> DataFrame:
    """Fill what an edge lacks; a native ``length`` overrides ``length_m``."""
    have = set(edges.columns)
    none = F.lit(None).cast("double")
    pick = lambda c: F.col(c) if c in have else none
    length = F.coalesce(pick("length"), pick("length_m"))
    return edges.withColumns({
        "travel_time": F.coalesce(pick("travel_time"), F.coalesce(length, F.lit(1.0)) / F.lit(speed)),
        "congestion_level": F.coalesce(pick("congestion_level"), F.lit(1.0)),
        "length_m": length,
    })


def weigh_by_road_class(edges: DataFrame) -> DataFrame:
    """Congestion by road class and the travel time that follows from it."""
    cong = X.road_class_congestion(F.col("highway"))
    return edges.withColumns({
        "length_m": F.coalesce("length_m", F.lit(100.0)),
        "congestion_level": cong,
        "travel_time": X.travel_time(F.col("length_m"), cong),
    })


def drop_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src") != F.col("dst"))


def undirected_pairs(edges: DataFrame) -> DataFrame:
    """Each unordered pair of ends once."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def to_undirected(edges: DataFrame) -> DataFrame:
    """Directed -> undirected; reciprocal twins of equal length become one."""
    return edges.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")}).groupBy(
        "src", "dst", "length_m"
    ).agg(F.min("highway").alias("highway"))


def distinct_edges(edges: DataFrame, order: list[str]) -> DataFrame:
    """First edge of every unordered pair, by ``order``; folded map-side."""
    e = edges.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})
    rest = [c for c in e.columns if c not in ("src", "dst") and c not in order]
    return e.groupBy("src", "dst").agg(F.min(F.struct(*order, *rest)).alias("e")).select("src", "dst", "e.*")


def cheapest_edges(edges: DataFrame, weight: str) -> DataFrame:
    """The edge a shortest path pays for between two ends."""
    return distinct_edges(edges, [weight])


def keyed_edges(edges: DataFrame) -> DataFrame:
    """Key 0 where present, else the first key of a pair."""
    return distinct_edges(edges, ["edge_key"])


def remove_edges(edges: DataFrame, failed: DataFrame) -> DataFrame:
    """Edges without the failed pairs, whichever way those are written."""
    gone = failed.select(F.least("src", "dst").alias("_a"), F.greatest("src", "dst").alias("_b"))
    return edges.join(
        gone, (F.least("src", "dst") == F.col("_a")) & (F.greatest("src", "dst") == F.col("_b")), "left_anti"
    )


def remove_one_parallel(edges: DataFrame, failed: DataFrame) -> DataFrame:
    """Failure that takes only the first of several parallel edges."""
    gone = failed.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return edges.join(gone.withColumn("edge_key", F.lit(0)), ["src", "dst", "edge_key"], "left_anti")


def add_edges(edges: DataFrame, new: DataFrame, edge_type: str) -> DataFrame:
    """Graph plus bridges, every edge tagged with where it comes from."""
    old = edges if "edge_type" in edges.columns else edges.withColumn("edge_type", F.lit("original"))
    return old.unionByName(new.withColumn("edge_type", F.lit(edge_type)), allowMissingColumns=True)


def degree(edges: DataFrame) -> DataFrame:
    """Degree of every node that has an edge; a self-loop counts twice."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def terminals(edges: DataFrame) -> DataFrame:
    """Dead ends: nodes of degree one."""
    return degree(edges).where(F.col("degree") == 1).select("node_id")


def first_neighbour(edges: DataFrame) -> DataFrame:
    """One neighbour per node, the smallest; a terminal has only one."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.groupBy(F.col("src").alias("node_id")).agg(F.min("dst").alias("neighbour"))


def both_ways(edges: DataFrame) -> DataFrame:
    p = undirected_pairs(drop_self_loops(edges))
    return p.unionByName(p.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def core_number(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """k-core decomposition by h-index rounds (Montresor et al. 2013).

    A node's bound falls to the h-index of its neighbours' bounds until
    nothing moves. Neighbours are counted per bound before the h-index is
    taken, so a hub costs as many rows as it has distinct bounds. Only nodes
    with a neighbour that moved are looked at again.
    """
    adj = cut_lineage(both_ways(edges))
    bound = adj.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("core"))
    bound = cut_lineage(bound)
    looked = adj
    tables, steps = Rounds(), Rounds()
    while True:
        own = bound.select(F.col("node_id").alias("src"), F.col("core").alias("own"))
        near = bound.select(F.col("node_id").alias("dst"), "core")
        counts = (
            looked.join(near, "dst").join(own, "src")
            .groupBy("src", F.least("core", "own").alias("v"))
            .agg(F.count(F.lit(1)).alias("n"), F.first("own").alias("own"))
        )
        down = Window.partitionBy("src").orderBy(F.col("v").desc())
        h = counts.withColumn("above", F.sum("n").over(down)).groupBy("src").agg(
            F.max(F.least("v", "above")).alias("now"), F.first("own").alias("own")
        )
        (fell,) = steps.cut(h.where(F.col("now") < F.col("own")).select(F.col("src").alias("node_id"), "now"))
        if fell.isEmpty():
            break
        (bound,) = tables.cut(bound.join(fell, "node_id", "left").select("node_id", F.coalesce("now", "core").alias("core")))
        told = adj.join(fell.select(F.col("node_id").alias("dst")), "dst", "left_semi").select("src").distinct()
        looked = adj.join(steps.cut(told)[0], "src", "left_semi")
    return nodes.select("node_id").join(bound, "node_id", "left").select(
        "node_id", F.coalesce("core", F.lit(0).cast("bigint")).alias("core_number")
    )


def backbone(cores: DataFrame, share: float = 0.7) -> DataFrame:
    """Nodes whose core number reaches ``share`` of the highest."""
    bar = cores.agg(F.greatest(F.lit(1).cast("bigint"), F.floor(F.max("core_number") * share)).alias("bar"))
    return cores.join(F.broadcast(bar)).select(  # one row
        "node_id", "core_number", (F.col("core_number") >= F.col("bar")).alias("in_backbone")
    )


def composite_criticality(between: DataFrame, spine: DataFrame) -> DataFrame:
    """0.7 of scaled betweenness and 0.3 for backbone membership."""
    top = between.agg(F.coalesce(F.max("betweenness"), F.lit(1.0)).alias("top"))
    flag = F.when(F.col("in_backbone"), 1.0).otherwise(0.0)
    score = 0.7 * (F.coalesce("betweenness", F.lit(0.0)) / (F.col("top") + 1e-9)) + 0.3 * flag
    return (
        spine.join(between, "node_id", "left")
        .join(F.broadcast(top))  # one row
        .withColumn("criticality", score)
        .select(
            "node_id", "criticality", "in_backbone", "core_number", "betweenness",
            X.criticality_color(F.col("criticality")).alias("color"),
        )
    )


def edge_criticality(edges: DataFrame, scored: DataFrame) -> DataFrame:
    """An edge is as critical as its worse end."""
    a = scored.select(F.col("node_id").alias("src"), F.col("criticality").alias("_a"))
    b = scored.select(F.col("node_id").alias("dst"), F.col("criticality").alias("_b"))
    top = F.greatest(F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0)))
    out = edges.join(a, "src", "left").join(b, "dst", "left").withColumn("criticality", top)
    return out.drop("_a", "_b").withColumns({
        "color": X.criticality_color(F.col("criticality")),
        "width": X.criticality_width(F.col("criticality")),
    })


def band_counts(scored: DataFrame) -> DataFrame:
    c = F.col("criticality")
    return scored.agg(
        F.count_if(c >= 0.7).alias("high"),
        F.count_if((c >= 0.3) & (c < 0.7)).alias("mid"),
        F.count_if(c < 0.3).alias("low"),
    )
