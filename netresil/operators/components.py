"""Connected components and what is counted over them.

Star contraction (Kiveris et al. 2014) over DataFrames, after rounds that merge
neighbours until the graph is small enough for it. ``keys`` runs many
graphs at once, one per key: that is how blocks and scenarios are processed.
A hub may hold a third of all edges: its neighbours are never collected, only
their minimum is taken (pre-aggregated map-side), and the join that sends the
minimum back leaves hot keys to adaptive skew splitting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netresil.functions.rounding import round_even
from netresil.session import Rounds, cut_lineage


#: Edges up to which rounds of stars are taken; each of them rewrites every edge.
STAR_EDGES = 1 << 18


def _large_star(e: DataFrame, keys: list[str], rounds: Rounds) -> DataFrame:
    both = e.unionByName(e.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst")))
    # Written first: a minimum taken inside the join's own stage would keep AQE from splitting a hub.
    (low,) = rounds.cut(both.groupBy(*keys, "src").agg(F.least(F.min("dst"), F.col("src")).alias("low")))
    return (
        both.join(low, [*keys, "src"])
        .where(F.col("dst") > F.col("src"))
        .select(*keys, F.col("dst").alias("src"), F.col("low").alias("dst"))
    )


def _small_star(e: DataFrame, keys: list[str]) -> DataFrame:
    """Edges point from the larger to the smaller id."""
    low = e.groupBy(*keys, "src").agg(F.min("dst").alias("low"))
    sent = e.join(low, [*keys, "src"]).select(
        *keys,
        F.when(F.col("dst") == F.col("low"), F.col("src")).otherwise(F.col("dst")).alias("src"),
        F.col("low").alias("dst"),
    )
    return sent.distinct()


def _tangled(e: DataFrame, keys: list[str]) -> bool:
    """Whether some node still points at two others or is pointed at as well."""
    ends = e.select(*keys, F.col("src").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("hub")).unionByName(
        e.select(*keys, F.col("dst").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("hub"))
    )
    bad = ends.groupBy(*keys, "n").agg(F.sum("out").alias("out"), F.max("hub").alias("hub")).where(
        (F.col("out") > 1) | ((F.col("out") > 0) & (F.col("hub") > 0))
    )
    return bad.limit(1).count() > 0


def star_labels(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, src, dst`` -> ``keys, node_id, component`` for every node with an edge.

    Stars rewrite all edges in every round, so they are left to graphs of at
    most ``STAR_EDGES`` edges; a larger one is contracted first.
    """
    keys = list(keys)
    edge_tables, label_tables = Rounds(), Rounds()
    (e,) = edge_tables.cut(_downwards(edges, keys))  # written: every round reads it more than once
    levels = []
    while e.count() > STAR_EDGES:
        level = _representatives(e, keys, len(levels), levels[-1][1] if levels else None)
        low = cut_lineage(level.groupBy(*keys, F.col("rep").alias("node_id")).agg(F.min("low").alias("low")))
        levels.append((level, low))
        (e,) = edge_tables.cut(_downwards(_relabelled(e, level, keys), keys))
    label = _stars(e, keys)
    if levels:
        # the stars know representatives only; a component's label is the smallest id merged into any of its own
        held = cut_lineage(label.join(levels[-1][1], [*keys, "node_id"]).select(*keys, "node_id", F.col("component").alias("root"), "low"))
        least = held.groupBy(*keys, "root").agg(F.min("low").alias("component"))
        label = held.join(least, [*keys, "root"]).select(*keys, "node_id", "component")
    for level, low in reversed(levels):
        # a representative without an edge left is a whole component
        known = low.join(label, [*keys, "node_id"], "left").select(*keys, F.col("node_id").alias("rep"), F.coalesce("component", "low").alias("component"))
        (label,) = label_tables.cut(level.join(known, [*keys, "rep"]).select(*keys, "node_id", "component"))
    return label


def _downwards(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct edges without loops, from the larger to the smaller id."""
    return edges.where(F.col("src") != F.col("dst")).select(
        *keys,
        F.greatest("src", "dst").alias("src"),
        F.least("src", "dst").alias("dst"),
    ).distinct()


def _representatives(e: DataFrame, keys: list[str], seed: int, low: DataFrame | None) -> DataFrame:
    """One round of random contraction (Boegeholz, Brand and Todor 2020): ``node_id, rep, low``.

    Every node is merged into the one of its neighbours, or itself, whose hash
    is the smallest. The hash changes per round, so a share of the nodes is
    expected to go whatever the ids; the largest of a neighbourhood always goes.
    ``low`` is the smallest original id merged into the node so far.
    """
    order = lambda c: F.struct(F.xxhash64(F.lit(seed), F.col(c)).alias("h"), F.col(c).alias("id"))
    near = e.select(*keys, F.col("src").alias("node_id"), order("dst").alias("p")).unionByName(
        e.select(*keys, F.col("dst").alias("node_id"), order("src").alias("p"))
    ).groupBy(*keys, "node_id").agg(F.min("p").alias("p"))
    near = near.withColumn("low", F.col("node_id")) if low is None else near.join(low, [*keys, "node_id"])
    return cut_lineage(near.select(*keys, "node_id", F.least("p", order("node_id"))["id"].alias("rep"), "low"))


def _relabelled(e: DataFrame, level: DataFrame, keys: list[str]) -> DataFrame:
    """The edges between representatives."""
    end = lambda c: level.select(*keys, F.col("node_id").alias(c), F.col("rep").alias(f"{c}_rep"))
    return e.join(end("src"), [*keys, "src"]).join(end("dst"), [*keys, "dst"]).select(
        *keys, F.col("src_rep").alias("src"), F.col("dst_rep").alias("dst"))


def _stars(e: DataFrame, keys: list[str]) -> DataFrame:
    lows, tables = Rounds(), Rounds()
    while True:
        (e,) = tables.cut(_small_star(_large_star(e, keys, lows), keys))
        if not _tangled(e, keys):
            break
    hub = e.select(*keys, F.col("dst").alias("node_id"), F.col("dst").alias("component")).distinct()
    return e.select(*keys, F.col("src").alias("node_id"), F.col("dst").alias("component")).unionByName(hub)


def connected_components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Component of every node; its label is the smallest node id in it.

    Nodes without edges are components of their own.
    """
    keys = list(keys)
    labels = star_labels(edges, keys)
    return nodes.select(*keys, "node_id").join(labels, [*keys, "node_id"], "left").select(
        *keys, "node_id", F.coalesce("component", "node_id").alias("component")
    )


def joined_components(components: DataFrame, edges: DataFrame) -> DataFrame:
    """The components once ``edges`` have been added; only those that an edge joins are looked at."""
    at = lambda c: components.select(F.col("node_id").alias(c), F.col("component").alias(f"{c}_component"))
    ends = edges.join(at("src"), "src").join(at("dst"), "dst")
    joined = star_labels(ends.select(F.col("src_component").alias("src"), F.col("dst_component").alias("dst")))
    to = joined.select(F.col("node_id").alias("component"), F.col("component").alias("to"))
    return components.join(to, "component", "left").select("node_id", F.coalesce("to", "component").alias("component"))


def component_sizes(components: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return components.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("nodes"))


def largest_component(sizes: DataFrame) -> DataFrame:
    """The largest component; the smaller label wins ties."""
    return sizes.agg(
        F.max_by("component", F.struct(F.col("nodes"), -F.col("component"))).alias("component"),
        F.max("nodes").alias("nodes"),
    )


def largest_component_nodes(components: DataFrame) -> DataFrame:
    """Nodes of the largest component (left semi join on its label)."""
    return components.join(largest_component(component_sizes(components)), "component", "left_semi")


def network_summary(nodes: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    """One row: counts, length, connectivity and resilience in all their roundings."""
    by_comp = component_sizes(components).agg(
        F.sum("nodes").cast("bigint").alias("nodes"),
        F.count(F.lit(1)).alias("components"),
        F.max("nodes").alias("largest"),
    )
    by_edge = edges.agg(
        F.count(F.lit(1)).alias("edges"),
        (F.coalesce(F.sum("length_m"), F.lit(0.0)) / 1000.0).alias("km"),
        (F.coalesce(F.sum(F.coalesce("length_m", F.lit(1.0))), F.lit(0.0)) / 1000.0).alias("km_filled"),
    )
    n = F.greatest(F.col("nodes"), F.lit(1))
    share = F.col("largest") / n
    return by_comp.join(F.broadcast(by_edge)).select(  # two one-row aggregates
        "nodes", "edges", "components", "largest",
        round_even("km", 1).alias("total_km"),
        round_even(share * 100, 2).alias("connectivity"),
        round_even(share * 100, 1).alias("connectivity_report"),
        round_even(share, 3).alias("connectivity_ratio"),
        round_even(1.0 - F.col("components") / n, 3).alias("resilience"),
        round_even(1.0 - F.col("components") / n, 4).alias("resilience_summary"),
        round_even(
            F.greatest(F.lit(0), F.col("components") - 1) / F.greatest(F.col("km_filled"), F.lit(0.001)), 3
        ).alias("break_density"),
    )


def break_density(components: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: ``components, km, density``, breaks per kilometre."""
    n = components.agg(F.count_distinct("component").alias("components"))
    km = edges.agg(
        F.greatest(F.coalesce(F.sum(F.coalesce("length_m", F.lit(1.0))), F.lit(0.0)) / 1000.0, F.lit(0.001)).alias("km")
    )
    return n.join(F.broadcast(km)).select(  # two one-row aggregates
        "components", "km", (F.greatest(F.col("components") - 1, F.lit(0)) / F.col("km")).alias("density")
    )


def quality_report(stages: DataFrame) -> DataFrame:
    """Reduction of break density against the stage named ``before``.

    ``stages`` has ``stage, components, km, density``, one row per stage.
    """
    base = stages.agg(F.max(F.when(F.col("stage") == "before", F.col("density"))).alias("base"))
    return stages.join(F.broadcast(base)).select(  # one row
        "stage", "components", "km", "density",
        (100.0 * (F.col("base") - F.col("density")) / F.greatest(F.col("base"), F.lit(1e-9))).alias("reduction_pct"),
    )


def same_component(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """``src, dst`` node ids (null when unsnapped) -> ``same``."""
    a = components.select(F.col("node_id").alias("src"), F.col("component").alias("src_component"))
    b = components.select(F.col("node_id").alias("dst"), F.col("component").alias("dst_component"))
    return pairs.join(a, "src", "left").join(b, "dst", "left").withColumn(
        "same", F.coalesce(F.col("src_component") == F.col("dst_component"), F.lit(False))
    )
