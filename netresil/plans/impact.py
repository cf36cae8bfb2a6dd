"""What does each incident's failure zone do to the network?

Incidents come as a table and are answered together. Recomputing the
components of the whole network per incident would cost incidents x network.
Instead the plane is divided top-down: inside a block of the plane all edges
no incident of the block can reach are contracted once, so what is left per
block is about the size of the block. Each level splits blocks 4 x 4 and costs
a constant number of passes over the edges; as soon as a block fits one task it
goes there with its incidents (see ``operators.blocks``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netresil.functions import expressions as X
from netresil.functions.projection import utm_to_wgs84
from netresil.functions.rounding import round_even
from netresil.operators.blocks import Block, after_failures
from netresil.operators.components import component_sizes, connected_components
from netresil.operators.graph import cheapest_edges, undirected_pairs
from netresil.operators.plane import plane_labels, task_labels
from netresil.operators.routing import (
    BYPASS_NOTE, ISOLATED, adjacency, nearest_outside, route_coords, route_metrics, shortest_paths,
)
from netresil.operators.spatial import edge_endpoints, nodes_in_zone, segments_within, snap
from netresil.session import cut_lineage

SPLIT = 4.0
#: Streets of a block, and incidents answered with it, that one task may hold.
BLOCK_EDGES, BLOCK_INCIDENTS = 1 << 19, 1024
#: How often the streets of all blocks may be sent, on average, before blocks are split further.
MOST_COPIES = 4

#: What the rows sent to a block's task are.
STREET, NODE, ZONE, FAILED, CLOSED = range(5)


def street_segments(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each connected pair of nodes once, with the coordinates of both."""
    return edge_endpoints(undirected_pairs(edges), nodes)


def failed_pairs(incidents: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge pairs each incident takes out, with their end coordinates."""
    return segments_within(incidents, street_segments(nodes, edges))


def _levels(incidents: DataFrame, nodes: DataFrame) -> list[float]:
    """Block sizes, coarse to fine; the finest is at least two radii wide."""
    r = incidents.agg(F.max("radius_m")).first()[0] or 1.0
    box = nodes.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    span = max(box[1] - box[0], box[3] - box[2], 1.0) if box[0] is not None else 1.0
    sizes = [2.0 ** math.ceil(math.log2(2 * max(r, 1.0)))]
    # blocks half as wide as the network or wider hold nearly all of it
    while sizes[-1] * SPLIT * 2 < span:
        sizes.append(sizes[-1] * SPLIT)
    return sizes[::-1]


def after_failure(incidents: DataFrame, nodes: DataFrame, segments: DataFrame, failed: DataFrame) -> DataFrame:
    """``(incident_id, components_after, largest_after)`` for every incident.

    ``segments`` as from ``street_segments``. A network of at most
    ``BLOCK_EDGES`` streets is one block for all incidents. Larger ones are
    divided first, by radius, in classes of a factor of sixteen: a block is
    never wider than its own class needs, so one huge zone does not enlarge the
    work of small ones.
    """
    incidents = cut_lineage(incidents.select("incident_id", "x", "y", "radius_m", F.monotonically_increasing_id().alias("number")))
    failed = failed.join(incidents.select("incident_id", "number"), "incident_id").select("number", "src", "dst")
    segs = cut_lineage(segments.where(F.col("src") != F.col("dst")).select(
        "src", "dst", F.least("ax", "bx").alias("x0"), F.greatest("ax", "bx").alias("x1"), F.least("ay", "by").alias("y0"), F.greatest("ay", "by").alias("y1")))
    if segs.count() <= BLOCK_EDGES:
        zero = F.lit(0).cast("bigint")
        graph = segs.select(zero.alias("bx_"), zero.alias("by_"), F.col("src").alias("u"), F.col("dst").alias("v"), *segs.columns)
        ends = segs.select(F.explode(F.array("src", "dst")).alias("n")).distinct()
        weights = ends.select(zero.alias("bx_"), zero.alias("by_"), "n", F.lit(1).cast("bigint").alias("w"))
        lonely = nodes.select(F.col("node_id").alias("n")).join(ends, "n", "left_anti")
        shut = cut_lineage(lonely.groupBy(zero.alias("bx_"), zero.alias("by_")).agg(F.count(F.lit(1)).alias("closed"), F.lit(1).cast("bigint").alias("closed_max")))
        found = _in_tasks(incidents.withColumns({"bx_": zero, "by_": zero}), graph, weights, shut, failed)
    else:
        r = F.col("radius_m")
        most = max(incidents.where(F.abs(r) < 1e15).agg(F.max("radius_m")).first()[0] or 1.0, 1.0)
        cls = F.when(r.isNotNull(), F.coalesce(F.floor(F.log2(F.lit(most) / F.greatest(r, F.lit(1.0))) / 4), F.lit(0)))
        classes = sorted(r[0] for r in incidents.select(cls.alias("k")).where("k is not null").distinct().collect())
        found = None
        for k in classes or [0]:
            one = _divided(incidents.where(cls == k), nodes, segs, failed)
            found = one if found is None else found.unionByName(one)
    return incidents.select("incident_id", "number").join(found, "number").select("incident_id", "components_after", "largest_after")


def _in_tasks(placed: DataFrame, graph: DataFrame, weights: DataFrame, shut: DataFrame | None, failed: DataFrame) -> DataFrame:
    """``number, components_after, largest_after`` of placed incidents, one task per block and at most ``BLOCK_INCIDENTS`` of them.

    A block with more incidents is sent once for each part of them.
    """
    key = ["bx_", "by_"]
    zero, none = F.lit(0).cast("bigint"), F.lit(0.0)
    parts = cut_lineage(placed.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK_INCIDENTS).alias("parts")))
    dealt = cut_lineage(placed.join(parts, key).withColumn("part", F.pmod(F.xxhash64("number"), F.col("parts"))).drop("parts"))
    copies = parts.select(*key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))

    def rows(df, kind, **of):
        cols = {c: zero for c in "abcd"} | {c: none for c in "pqrs"} | {c: F.col(v) for c, v in of.items()}
        return df.select(*key, "part", F.lit(kind).cast("tinyint").alias("kind"), *[F.coalesce(v, zero if c in "abcd" else none).alias(c) for c, v in cols.items()])

    held = (
        rows(graph.join(copies, key), STREET, a="u", b="v", c="src", d="dst", p="x0", q="x1", r="y0", s="y1")
        .unionByName(rows(weights.join(copies, key), NODE, a="n", b="w"))
        .unionByName(rows(dealt, ZONE, a="number", p="x", q="y", r="radius_m"))
        .unionByName(rows(failed.join(dealt.select("number", *key, "part"), "number"), FAILED, a="number", c="src", d="dst"))
    )
    if shut is not None:
        held = held.unionByName(rows(shut.join(copies, key), CLOSED, a="closed", b="closed_max"))
    return cut_lineage(held.groupBy(*key, "part").applyInPandas(_block_answers, "number bigint, components_after bigint, largest_after bigint"))


def _block_answers(table: pd.DataFrame) -> pd.DataFrame:
    kind = table["kind"].to_numpy()
    street, node, zone, failed, closed = (table[kind == k].reset_index(drop=True) for k in (STREET, NODE, ZONE, FAILED, CLOSED))
    ids = np.unique(np.concatenate([node["a"], street["a"], street["b"]]).astype(np.int64))
    weight = np.zeros(len(ids), np.int64)
    np.add.at(weight, np.searchsorted(ids, node["a"]), node["b"].to_numpy())
    u, v = (np.searchsorted(ids, street[c]) for c in "ab")
    block = Block(u, v, np.arange(len(street)), weight, int(closed["a"].sum()), int(closed["b"].max()) if len(closed) else 0)
    zone = zone.sort_values("a").reset_index(drop=True)
    met = failed[["a", "c", "d"]].merge(street[["c", "d"]].assign(row=np.arange(len(street))), on=["c", "d"]).sort_values("a")
    found = after_failures(
        block, street[list("pqrs")].to_numpy(float), zone[list("pqr")].to_numpy(float), np.searchsorted(zone["a"], met["a"]), met["row"].to_numpy(np.int64))
    return pd.DataFrame({"number": zone["a"], "components_after": found[:, 0], "largest_after": found[:, 1]})


def _divided(incidents: DataFrame, nodes: DataFrame, segs: DataFrame, failed: DataFrame) -> DataFrame:
    """Answers on a large network: blocks are split 4 x 4 until they and their incidents fit a task.

    Streets deep inside a block, out of reach of all incidents of its neighbours,
    are contracted once for all of them, so a block is copied to its neighbours
    as the strip along its border. A block of the smallest size that still does
    not fit is answered incident by incident, by the joins that find components.
    """
    key, home, kid = ["bx_", "by_"], ["hx", "hy"], ["cx", "cy"]
    zero = F.lit(0).cast("bigint")
    graph = segs.select(
        zero.alias("bx_"), zero.alias("by_"), F.col("src").alias("u"), F.col("dst").alias("v"),
        "src", "dst", "x0", "x1", "y0", "y1",
    )
    weights = cut_lineage(nodes.groupBy(zero.alias("bx_"), zero.alias("by_"), F.col("node_id").alias("n")).agg(F.count(F.lit(1)).alias("w")))
    shut = None  # components already closed off: count and largest, per block
    inc = incidents
    reach = F.lit(float(inc.agg(F.max("radius_m")).first()[0] or 0.0))
    sizes = _levels(inc, nodes)
    for i, size in enumerate(sizes):
        at = lambda c, s=size: F.floor(F.col(c) / F.lit(s)).cast("bigint")
        up = (lambda c: zero) if i == 0 else (lambda c, s=sizes[i - 1]: F.floor(F.col(c) / F.lit(s)).cast("bigint"))
        blocks = cut_lineage(inc.groupBy(at("x").alias("cx"), at("y").alias("cy"), up("x").alias("bx_"), up("y").alias("by_")).agg(
            F.max("radius_m").alias("r"), F.count(F.lit(1)).alias("asked")
        ))
        near = (
            (F.col("x1") + F.col("r") >= F.col("cx") * size) & (F.col("x0") - F.col("r") <= (F.col("cx") + 1) * size)
            & (F.col("y1") + F.col("r") >= F.col("cy") * size) & (F.col("y0") - F.col("r") <= (F.col("cy") + 1) * size)
        )
        deep = (
            (F.col("x0") - reach > F.col("hx") * size) & (F.col("x1") + reach < (F.col("hx") + 1) * size)
            & (F.col("y0") - reach > F.col("hy") * size) & (F.col("y1") + reach < (F.col("hy") + 1) * size)
        )
        marked = cut_lineage(graph.withColumns({"hx": at("x0"), "hy": at("y0")}).withColumn("deep", F.coalesce(deep, F.lit(False))))
        strip = marked.where(~F.col("deep")).drop(*home, "deep")
        cells = plane_labels(marked.where("deep").select(
            *key, *home, F.col("u").alias("src"), F.col("v").alias("dst"), F.col("x0").alias("x"), F.col("y0").alias("y")), [*key, *home])
        # what several cells or the strips touch is seen by all blocks, the rest of a cell by its own block alone
        met = cells.select(*key, F.col("node_id").alias("n"), F.lit(1).alias("k")).unionByName(
            strip.select(*key, F.explode(F.array("u", "v")).alias("n")).distinct().withColumn("k", F.lit(2)))
        met = cut_lineage(met.groupBy(*key, "n").agg((F.sum("k") > 1).alias("seen")).join(weights, [*key, "n"]))
        cells = cut_lineage(cells.withColumnRenamed("node_id", "n").join(met, [*key, "n"]))
        merged = cut_lineage(cells.groupBy(*key, *home, "component").agg(
            F.sum(F.when(~F.col("seen"), F.col("w"))).alias("w"), F.max("seen").alias("open")))
        lost = merged.where(~F.col("open")).groupBy(*key, *home).agg(F.count(F.lit(1)).alias("closed"), F.max("w").alias("closed_max"))
        lone = weights.join(met, [*key, "n"], "left_anti").groupBy(*key).agg(F.count(F.lit(1)).alias("closed"), F.max("w").alias("closed_max"))
        inside = (F.col("hx") == F.col("cx")) & (F.col("hy") == F.col("cy"))
        own = lambda df: df.join(blocks, key).where(inside)
        others = lambda df: df.join(blocks, key).where(~inside)
        strips = cut_lineage(strip.join(blocks, key).withColumn("near", near))
        whole = own(marked.where("deep")).withColumn("near", near)
        tied = others(cells.where(F.col("seen") & (F.col("n") != F.col("component")))).select(*kid, F.col("n").alias("src"), F.col("component").alias("dst"))
        joined = task_labels(strips.where(~F.col("near")).select(*kid, F.col("u").alias("src"), F.col("v").alias("dst")).unionByName(tied), kid)
        joined = joined.withColumnRenamed("node_id", "n")
        held = met.where("seen").join(blocks, key).select(*kid, "n", "w").unionByName(
            others(merged.where(F.col("open") & F.col("w").isNotNull())).select(*kid, F.col("component").alias("n"), "w")).unionByName(
            own(cells.where(~F.col("seen"))).select(*kid, "n", "w"))
        weighed = cut_lineage(held.join(joined, [*kid, "n"], "left").groupBy(*kid, F.coalesce("component", "n").alias("n")).agg(F.sum("w").alias("w")))
        lab_u = joined.select(*kid, F.col("n").alias("u"), F.col("component").alias("lu"))
        lab_v = joined.select(*kid, F.col("n").alias("v"), F.col("component").alias("lv"))
        kept = ["cx", "cy", "u", "v", "src", "dst", "x0", "x1", "y0", "y1"]
        graph_next = cut_lineage(
            strips.where("near").select(*kept).unionByName(whole.where("near").select(*kept))
            .join(lab_u, [*kid, "u"], "left").join(lab_v, [*kid, "v"], "left")
            .select(
                F.col("cx").alias("bx_"), F.col("cy").alias("by_"),
                F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v"),
                "src", "dst", "x0", "x1", "y0", "y1",
            )
            .where(F.col("u") != F.col("v"))
        )
        live = graph_next.select(*key, F.explode(F.array("u", "v")).alias("n")).distinct()
        weighed = weighed.select(F.col("cx").alias("bx_"), F.col("cy").alias("by_"), "n", "w")
        closed = weighed.join(live, [*key, "n"], "left_anti").groupBy(*key).agg(
            F.count(F.lit(1)).alias("closed"), F.max("w").alias("closed_max")
        )
        down = lambda df: df.select(F.col("cx").alias("bx_"), F.col("cy").alias("by_"), "closed", "closed_max")
        closed = closed.unionByName(down(others(lost))).unionByName(down(lone.join(blocks, key)))
        if shut is not None:
            closed = closed.unionByName(down(shut.join(blocks, key)))
        shut = cut_lineage(closed.groupBy(*key).agg(F.sum("closed").cast("bigint").alias("closed"), F.max("closed_max").alias("closed_max")))
        weights = cut_lineage(weighed.join(live, [*key, "n"], "left_semi"))
        graph = graph_next
        count = cut_lineage(graph.groupBy(*key).count())
        crowded = count.where(F.col("count") > BLOCK_EDGES).drop("count")
        # a block with more incidents than a task takes is sent several times: going on is cheaper than many copies
        parts = F.ceil(F.col("asked") / BLOCK_INCIDENTS)
        sent, once = count.join(blocks.select(F.col("cx").alias("bx_"), F.col("cy").alias("by_"), "asked"), key).agg(
            F.sum(F.col("count") * parts), F.sum("count")).first()
        if crowded.isEmpty() and (sent or 0) <= MOST_COPIES * (once or 0):
            break

    placed = inc.withColumns({c: F.floor(F.col(v) / F.lit(size)).cast("bigint") for c, v in (("bx_", "x"), ("by_", "y"))})
    crowded = cut_lineage(crowded)
    fits = placed.join(crowded, key, "left_anti")
    light = _in_tasks(fits, graph.join(crowded, key, "left_anti"), weights.join(crowded, key, "left_anti"), shut, failed)
    if crowded.isEmpty():
        return light
    return light.unionByName(_by_joins(placed.join(crowded, key, "left_semi").select("number", *key), graph, weights, shut, failed))


def _by_joins(placed: DataFrame, graph: DataFrame, weights: DataFrame, shut: DataFrame, failed: DataFrame) -> DataFrame:
    key = ["bx_", "by_"]
    kept = graph.select(*key, "u", "v", "src", "dst").join(placed, key).join(
        failed.select("number", "src", "dst"), ["number", "src", "dst"], "left_anti"
    )
    own = weights.join(placed, key).select("number", F.col("n").alias("node_id"), "w")
    comp = connected_components(
        own, kept.select("number", F.col("u").alias("src"), F.col("v").alias("dst")), ["number"]
    )
    open_ = own.join(comp, ["number", "node_id"]).groupBy("number", "component").agg(F.sum("w").alias("w")).groupBy(
        "number"
    ).agg(F.count(F.lit(1)).alias("open"), F.max("w").alias("open_max"))
    none = F.lit(0).cast("bigint")
    return placed.join(shut, key, "left").join(open_, "number", "left").select(
        "number",
        (F.coalesce("closed", none) + F.coalesce("open", none)).alias("components_after"),
        F.greatest(F.coalesce("closed_max", none), F.coalesce("open_max", none)).cast("bigint").alias("largest_after"),
    )


def baseline(nodes: DataFrame, edges: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """One row: nodes, components and the size of the largest."""
    comp = connected_components(nodes, edges) if components is None else components
    return component_sizes(comp).agg(
        F.sum("nodes").cast("bigint").alias("nodes"), F.count(F.lit(1)).alias("components_before"),
        F.max("nodes").alias("largest_before"),
    )


@dataclass
class Network:
    """What does not depend on incidents: nodes, segments and the figures before any failure."""

    nodes: DataFrame
    segments: DataFrame
    base: DataFrame


def prepare(nodes: DataFrame, edges: DataFrame) -> Network:
    nodes = cut_lineage(nodes)
    segments = cut_lineage(street_segments(nodes, edges))
    found = plane_labels(segments.select("src", "dst", F.col("ax").alias("x"), F.col("ay").alias("y")))
    components = nodes.select("node_id").join(found, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))
    return Network(nodes, segments, cut_lineage(baseline(nodes, segments, components)))


def impact(incidents: DataFrame, nodes: DataFrame, edges: DataFrame, population: DataFrame | None = None) -> DataFrame:
    """Key figures per incident.

    ``population(incident_id, population_affected)`` is optional; without it
    the head count of a densely settled disc is assumed.
    """
    return impact_on(prepare(nodes, edges), incidents, population)


def impact_on(network: Network, incidents: DataFrame, population: DataFrame | None = None) -> DataFrame:
    """Key figures per incident on a prepared network."""
    nodes, segments, base, incidents = network.nodes, network.segments, network.base, cut_lineage(incidents)
    failed = cut_lineage(segments_within(incidents, segments))
    removed = failed.groupBy("incident_id").agg(F.count(F.lit(1)).alias("removed"))
    after = after_failure(incidents, nodes, segments, failed)
    n = F.col("nodes")
    out = (
        incidents.join(F.broadcast(base))  # one row
        .join(after, "incident_id")
        .join(removed, "incident_id", "left")
        .join(nodes_in_zone(incidents, nodes), "incident_id", "left")
    )
    if population is not None:
        out = out.join(population, "incident_id", "left")
    else:
        out = out.withColumn("population_affected", F.lit(None).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    out = out.select(
        "incident_id", "components_before", "components_after",
        F.greatest(zero, F.col("components_after") - F.col("components_before")).alias("disconnected_wards"),
        F.coalesce("population_affected", X.population_fallback(F.col("radius_m"))).alias("population_affected"),
        round_even(F.col("largest_before") / n * 100, 2).alias("connectivity_before"),
        round_even(F.col("largest_after") / n * 100, 2).alias("connectivity_after"),
        round_even(1.0 - F.col("components_before") / n, 3).alias("resilience_before"),
        round_even(1.0 - F.col("components_after") / n, 3).alias("resilience_after"),
        F.coalesce("removed", zero).alias("edges_removed"),
        F.coalesce("nodes_in_zone", zero).alias("nodes_in_zone"),
    )
    score = X.priority_score(F.col("edges_removed"), F.col("connectivity_before"), F.col("connectivity_after"))
    return out.withColumn("priority_score", score).withColumn(
        "emergency_priority", X.emergency_priority(F.col("priority_score"))
    )


def failed_segments(incidents: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every failed segment of every incident, scored and with lon/lat ends."""
    attrs = cheapest_edges(edges, "length_m").select("src", "dst", "length_m", "congestion_level")
    hit = failed_pairs(incidents, nodes, edges).join(attrs, ["src", "dst"])
    a = F.array(*utm_to_wgs84(F.col("ax"), F.col("ay")))
    b = F.array(*utm_to_wgs84(F.col("bx"), F.col("by")))
    score = X.segment_score(F.col("length_m"), F.col("congestion_level"))
    return hit.select(
        "incident_id", X.feature_id("SEG", F.col("src"), F.col("dst")).alias("id"), "src", "dst",
        X.segment_criticality(score).alias("criticality"), score.alias("score"),
        X.segment_length(F.col("length_m")).alias("length_m"), F.array(a, b).alias("coordinates"),
    )


def snap_ends(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """``query_id, src, dst, snap_message`` of requests with both places in
    metres (``sx, sy, ex, ey``) and a limit of their own (``max_snap_dist_m``);
    the message is that of the first end without a road."""
    end = lambda tag, x, y: requests.select(
        F.struct("query_id", F.lit(tag).alias("end")).alias("point_id"), F.col(x).alias("x"), F.col(y).alias("y"), "max_snap_dist_m")
    at = snap(end("s", "sx", "sy").unionByName(end("e", "ex", "ey")), nodes)
    of = lambda tag, c: F.max(F.when(F.col("point_id.end") == tag, F.col(c)))
    return cut_lineage(at.groupBy(F.col("point_id.query_id").alias("query_id")).agg(
        of("s", "node_id").alias("src"), of("e", "node_id").alias("dst"),
        F.coalesce(of("s", "message"), of("e", "message")).alias("snap_message"),
    ))


def compare_routes(requests: DataFrame, nodes: DataFrame, edges: DataFrame, max_snap_m: float = 3000.0) -> DataFrame:
    """Normal and safe route of each request, with the bypass where needed.

    ``requests(query_id, x, y, radius_m, sx, sy, ex, ey[, max_snap_dist_m])``: a
    zone and two places, all in metres. Zones never remove nodes, only edges,
    and are judged edge by edge during the search, so no per-zone graph is
    built.
    """
    if "max_snap_dist_m" not in requests.columns:
        requests = requests.withColumn("max_snap_dist_m", F.lit(float(max_snap_m)))
    requests = cut_lineage(requests)
    at = snap_ends(requests, nodes)
    zone = requests.select("query_id", F.col("x").alias("zx"), F.col("y").alias("zy"), F.col("radius_m").alias("zr"))
    ok = at.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    adj = adjacency(nodes, edges, "travel_time")

    def metrics(od, tag):
        od = cut_lineage(od)
        costs, paths = shortest_paths(od.where(F.col("src") != F.col("dst")), nodes, edges, "travel_time", adj)
        paths = cut_lineage(paths)
        stay = od.where(F.col("src") == F.col("dst"))
        here = route_coords(stay.select("query_id", F.lit(0).alias("seq"), F.col("src").alias("node_id")), nodes)
        same = stay.select(
            "query_id", F.lit(0.0).alias("distance_km"), F.lit(0.0).alias("estimated_time_mins"),
            F.lit(0.0).alias("avg_congestion_multiplier"), F.lit(1).cast("bigint").alias("segments_count"), F.lit(0.0).alias("cost"),
        ).join(here, "query_id")
        got = route_metrics(paths, edges).join(costs, "query_id").join(route_coords(paths, nodes), "query_id").unionByName(same)
        return cut_lineage(got.select("query_id", *[F.col(c).alias(f"{tag}_{c}") for c in got.columns[1:]]))

    # normal and safe trips share every round of one search
    def as_kind(od, kind):
        return od.select(F.struct("query_id", F.lit(kind).alias("kind")).alias("query_id"), "src", "dst", "zx", "zy", "zr")

    none = F.lit(None).cast("double")
    both = metrics(
        as_kind(ok.withColumns({"zx": none, "zy": none, "zr": none}), "normal").unionByName(as_kind(ok.join(zone, "query_id"), "safe")), "any"
    )

    def of_kind(kind):
        cols = [F.col(c).alias(c.replace("any_", f"{kind}_")) for c in both.columns[1:]]
        return both.where(F.col("query_id.kind") == kind).select(F.col("query_id.query_id").alias("query_id"), *cols)

    normal, direct = of_kind("normal"), of_kind("safe")
    stuck = ok.join(direct, "query_id", "left_anti").join(zone, "query_id")
    pair = F.struct("query_id", "end").alias("query_id")
    sources = stuck.withColumn("end", F.lit("s")).select(pair, "src", "zx", "zy", "zr").unionByName(
        stuck.withColumn("end", F.lit("e")).select(pair, F.col("dst").alias("src"), "zx", "zy", "zr")
    )
    alt = nearest_outside(cut_lineage(sources), nodes, edges)
    alt = alt.groupBy(F.col("query_id.query_id").alias("query_id")).agg(
        F.max(F.when(F.col("query_id.end") == "s", F.col("node_id"))).alias("src"),
        F.max(F.when(F.col("query_id.end") == "e", F.col("node_id"))).alias("dst"),
    ).where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    bypass = metrics(cut_lineage(alt).join(zone, "query_id"), "safe").withColumn("note", F.lit(BYPASS_NOTE))
    safe = direct.withColumn("note", F.lit(None).cast("string")).unionByName(bypass)
    unsnapped = F.col("src").isNull() | F.col("dst").isNull()
    has = lambda t: F.col(f"{t}_distance_km").isNotNull()
    return requests.select("query_id").join(at, "query_id", "left").join(normal, "query_id", "left").join(
        safe, "query_id", "left"
    ).select(
        "query_id", "src", "dst",
        F.when(unsnapped, "error").when(has("normal"), "success").otherwise("no_path").alias("normal_status"),
        F.when(unsnapped, "error").when(has("safe"), "success").otherwise("isolated").alias("safe_status"),
        F.when(unsnapped, F.col("snap_message")).when(~has("safe"), F.lit(ISOLATED)).alias("message"),
        "note",
        *[F.col(f"{t}_{c}") for t in ("normal", "safe") for c in ("distance_km", "estimated_time_mins", "avg_congestion_multiplier", "segments_count", "cost", "route_coords")],
        round_even(F.col("safe_distance_km") - F.col("normal_distance_km"), 2).alias("detour_km"),
        round_even(F.col("safe_estimated_time_mins") - F.col("normal_estimated_time_mins"), 1).alias("detour_mins"),
    )
