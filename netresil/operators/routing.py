"""Many shortest paths at once.

Trips that stay within a block of the plane are searched in one task per block
(see ``trips``), the others over cells of growing width (see ``overlay``). Only
those with a zone beyond a block take rounds of joins keyed by (query, node).

In these a cheap search from both ends first finds the cost of some path per query, and
drops queries that have none. Then each round relaxes the edges of every
query's frontier. A query never follows an edge that cannot end up below the
best cost known for its own target: the straight line left to go, times the
smallest cost per metre found in the edges, is a lower bound whatever the
weights, so results are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netresil.functions import expressions as X
from netresil.functions.geometry import norm2, point_segment_distance
from netresil.functions.rounding import round_even
from netresil.operators.graph import cheapest_edges, drop_self_loops, undirected_pairs
from netresil.operators.overlay import overlay_trips
from netresil.operators.surroundings import hops_outside
from netresil.operators.trips import block_trips
from netresil.session import Rounds, cut_lineage

WEIGHTS = ("travel_time", "length_m")
BYPASS_REACH = 3.0

# The messages a request is answered with.
NO_PATH = "No navigable path between these points."
SAME_NODE = "Origin and destination are the same node."
BYPASS_NOTE = "Rerouted via bypass nodes outside failure zone"
ISOLATED = (
    "Area fully isolated — no bypass route possible. "
    "This zone has no alternate road connection."
)


def adjacency(nodes: DataFrame, edges: DataFrame, weight: str) -> DataFrame:
    """Both directions of the cheapest edges with the coordinates of both ends; edges without the weight are left out."""
    if weight not in edges.columns:
        raise ValueError(f"no such weight: {weight}")
    # an edge without this weight can't be travelled; left in, its null would sort before every distance
    e = edges.select("src", "dst", F.col(weight).alias("w")).where(F.col("w").isNotNull())
    e = e.where(F.col("src") != F.col("dst"))
    e = e.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("w").alias("w"))
    u = nodes.select(F.col("node_id").alias("src"), F.col("x").alias("ux"), F.col("y").alias("uy"))
    v = nodes.select(F.col("node_id").alias("dst"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    one = e.join(u, "src").join(v, "dst").select(
        F.col("src").alias("u"), F.col("dst").alias("v"), "w", "ux", "uy", "vx", "vy"
    )
    back = one.select(
        F.col("v").alias("u"), F.col("u").alias("v"), "w",
        F.col("vx").alias("ux"), F.col("vy").alias("uy"), F.col("ux").alias("vx"), F.col("uy").alias("vy"),
    )
    return cut_lineage(one.unionByName(back))


def _cost_per_metre(adj: DataFrame) -> float:
    d = norm2(F.col("ux") - F.col("vx"), F.col("uy") - F.col("vy"))
    low = adj.where(d > 0).agg(F.min(F.col("w") / d)).first()[0]
    return max(low or 0.0, 0.0)


def _open_edge() -> Column:
    """Edges inside a query's failure zone are closed to it."""
    d = point_segment_distance(*[F.col(c) for c in ("zx", "zy", "ux", "uy", "vx", "vy")])
    return F.col("zr").isNull() | (d > F.col("zr"))


def probe(od: DataFrame, adj: DataFrame) -> DataFrame:
    """Which queries have a path, and a cost one of their paths does not exceed.

    Both ends grow outwards hop by hop. A query is settled when the two sides
    meet, at the cost of the path through the meeting node, or when one side
    has nowhere left to go: a target cut off in a pocket is found out after
    the pocket's few nodes instead of after the whole network.
    """
    none = F.lit(None).cast("double")
    zones = od.select("query_id", "zx", "zy", "zr")
    # d0, d1: cost from either end; f0, f1: reached in the last round
    state = cut_lineage(
        od.select("query_id", F.col("src").alias("node"), F.lit(0.0).alias("d0"), none.alias("d1"), F.lit(True).alias("f0"), F.lit(False).alias("f1"))
        .unionByName(od.select(
            "query_id", F.col("dst").alias("node"), none.alias("d0"), F.lit(0.0).alias("d1"), F.lit(False).alias("f0"), F.lit(True).alias("f1")
        ))
    )
    tables = Rounds()
    while True:
        status = state.groupBy("query_id").agg(
            F.min(F.col("d0") + F.col("d1")).alias("bound"), F.max("f0").alias("a0"), F.max("f1").alias("a1")
        )
        alive = status.where(F.col("bound").isNull() & F.col("a0") & F.col("a1")).select("query_id")
        if alive.limit(1).count() == 0:
            return cut_lineage(status.where(F.col("bound").isNotNull()).select("query_id", "bound"))
        tried = (
            state.where(F.col("f0") | F.col("f1")).join(alive, "query_id", "left_semi").join(zones, "query_id")
            .join(adj, F.col("node") == F.col("u")).where(_open_edge())
            .select("query_id", F.col("v").alias("node"), none.alias("d0"), none.alias("d1"),
                    F.when(F.col("f0"), F.col("d0") + F.col("w")).alias("n0"), F.when(F.col("f1"), F.col("d1") + F.col("w")).alias("n1"))
        )
        kept = state.select("query_id", "node", "d0", "d1", none.alias("n0"), none.alias("n1"))
        g = kept.unionByName(tried).groupBy("query_id", "node").agg(
            F.max("d0").alias("d0"), F.max("d1").alias("d1"), F.min("n0").alias("n0"), F.min("n1").alias("n1")
        )
        (state,) = tables.cut(g.select(
            "query_id", "node", F.coalesce("d0", "n0").alias("d0"), F.coalesce("d1", "n1").alias("d1"),
            (F.col("d0").isNull() & F.col("n0").isNotNull()).alias("f0"), (F.col("d1").isNull() & F.col("n1").isNotNull()).alias("f1"),
        ))


def search(od: DataFrame, nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """``od(query_id, src, dst[, zx, zy, zr])`` -> ``(query_id, node, dist, pred)``."""
    rate = _cost_per_metre(adj)
    none = F.lit(None).cast("double")
    for c in ("zx", "zy", "zr"):
        if c not in od.columns:
            od = od.withColumn(c, none)
    goal = nodes.select(F.col("node_id").alias("dst"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    od = cut_lineage(od.join(goal, "dst").select("query_id", "src", "dst", "tx", "ty", "zx", "zy", "zr"))
    od = cut_lineage(od.join(probe(od, adj), "query_id"))
    state = cut_lineage(od.select(
        "query_id", F.col("src").alias("node"), F.lit(0.0).alias("dist"),
        F.lit(None).cast("bigint").alias("pred"), F.lit(True).alias("fresh"),
    ))
    tables = Rounds()
    while True:
        best = state.join(od.select("query_id", F.col("dst").alias("node")), ["query_id", "node"]).select(
            "query_id", F.col("dist").alias("best")
        )
        rules = od.drop("src").join(best, "query_id", "left").withColumn("best", F.least("best", "bound"))
        dist = F.col("dist") + F.col("w")
        left = norm2(F.col("vx") - F.col("tx"), F.col("vy") - F.col("ty")) * F.lit(rate)
        hope = dist + left <= F.col("best") * (1 + 1e-9)
        tried = (
            state.where("fresh").join(rules, "query_id")
            .join(adj, F.col("node") == F.col("u"))
            .where((F.col("pred").isNull() | (F.col("v") != F.col("pred"))) & _open_edge() & hope)
            .select("query_id", F.col("v").alias("node"), dist.alias("dist"), F.col("u").alias("pred"), F.lit(1).alias("new"))
        )
        kept = state.select("query_id", "node", "dist", "pred", F.lit(0).alias("new"))
        (state,) = tables.cut(
            kept.unionByName(tried).groupBy("query_id", "node")
            .agg(F.min(F.struct("dist", "new", "pred")).alias("b"))
            .select("query_id", "node", "b.dist", "b.pred", (F.col("b.new") == 1).alias("fresh"))
        )
        if state.where("fresh").limit(1).count() == 0:
            return state.drop("fresh")


def search_all(od: DataFrame, adj: DataFrame) -> DataFrame:
    """Distances from each query's ``src`` to every node: ``(query_id, node, dist)``."""
    state = cut_lineage(od.select("query_id", F.col("src").alias("node"), F.lit(0.0).alias("dist"), F.lit(True).alias("fresh")))
    tables = Rounds()
    while True:
        tried = state.where("fresh").join(adj, F.col("node") == F.col("u")).select(
            "query_id", F.col("v").alias("node"), (F.col("dist") + F.col("w")).alias("dist"), F.lit(1).alias("new")
        )
        (state,) = tables.cut(
            state.select("query_id", "node", "dist", F.lit(0).alias("new")).unionByName(tried)
            .groupBy("query_id", "node").agg(F.min(F.struct("dist", "new")).alias("b"))
            .select("query_id", "node", "b.dist", (F.col("b.new") == 1).alias("fresh"))
        )
        if state.where("fresh").limit(1).count() == 0:
            return state.drop("fresh")


def walk_back(od: DataFrame, state: DataFrame) -> DataFrame:
    """The path to each target, backwards: ``(query_id, back, node)``.

    Pointer doubling: in round k every node known to be on a path knows the one
    2^k steps before it, and each node found at distance d finds the one at
    d + 2^k. A path of n nodes takes log2(n) rounds.
    """
    jump = state.where(F.col("pred").isNotNull()).select("query_id", "node", F.col("pred").alias("to"))
    found = cut_lineage(od.select("query_id", F.col("dst").alias("node")).join(state.select("query_id", "node"), ["query_id", "node"]).select(
        "query_id", F.lit(0).cast("bigint").alias("back"), "node"))
    step = 1
    while True:
        more = cut_lineage(found.join(jump, ["query_id", "node"]).select("query_id", (F.col("back") + step).alias("back"), F.col("to").alias("node")))
        if more.limit(1).count() == 0:
            return found
        found = cut_lineage(found.unionByName(more))
        onward = jump.select("query_id", F.col("node").alias("to"), F.col("to").alias("onward"))
        jump = cut_lineage(jump.join(onward, ["query_id", "to"]).select("query_id", "node", F.col("onward").alias("to")))
        step *= 2


def shortest_paths(od: DataFrame, nodes: DataFrame, edges: DataFrame, weight: str = "travel_time",
                   adj: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Costs ``(query_id, cost)`` and paths ``(query_id, seq, node_id)``.

    Queries without a path are absent from both.
    """
    adj = adjacency(nodes, edges, weight) if adj is None else adj
    none = F.lit(None).cast("double")
    for c in ("zx", "zy", "zr"):
        if c not in od.columns:
            od = od.withColumn(c, none)
    place = lambda x, y, e: nodes.select(F.col("node_id").alias(e), F.col("x").alias(x), F.col("y").alias(y))
    asked = cut_lineage(od.select("query_id", "src", "dst", "zx", "zy", "zr", F.monotonically_increasing_id().alias("number")))
    trips = asked.drop("query_id").join(place("sx", "sy", "src"), "src").join(place("tx", "ty", "dst"), "dst")
    answers, left = block_trips(trips, adj, _cost_per_metre(adj))
    free = left.where(F.col("zr").isNull())
    if not free.isEmpty():
        long = overlay_trips(free, adj)
        answers = long if answers is None else answers.unionByName(long)
    far = cut_lineage(asked.join(left.where(F.col("zr").isNotNull()).select("number"), "number", "left_semi").drop("number"))
    costs = paths = None
    if answers is not None:
        found = cut_lineage(answers.join(asked.select("number", "query_id"), "number"))
        costs, paths = found.select("query_id", "cost"), found.select("query_id", F.posexplode("path").alias("seq", "node_id"))
        paths = paths.withColumn("seq", F.col("seq").cast("bigint"))
    if costs is None or not far.isEmpty():
        more = _by_rounds(far, nodes, adj)
        costs, paths = more if costs is None else (costs.unionByName(more[0]), paths.unionByName(more[1]))
    return costs, paths


def _by_rounds(od: DataFrame, nodes: DataFrame, adj: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Costs and paths of trips with a zone that are too long for a block, by rounds of joins."""
    state = search(od, nodes, adj)
    costs = state.join(od.select("query_id", F.col("dst").alias("node")), ["query_id", "node"]).select(
        "query_id", F.col("dist").alias("cost")
    )
    back = walk_back(od, state)
    length = back.groupBy("query_id").agg(F.max("back").alias("hops"))
    paths = back.join(length, "query_id").select(
        "query_id", (F.col("hops") - F.col("back")).alias("seq"), F.col("node").alias("node_id")
    )
    return costs, paths


def path_segments(paths: DataFrame) -> DataFrame:
    """Consecutive pairs of each path: ``(query_id, seq, u, v)``."""
    nxt = paths.select("query_id", (F.col("seq") - 1).alias("seq"), F.col("node_id").alias("v"))
    return paths.select("query_id", "seq", F.col("node_id").alias("u")).join(nxt, ["query_id", "seq"])


def first_parallel(edges: DataFrame) -> DataFrame:
    """Of parallel edges the one with key 0, or the lowest key where there is none."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    ends = {"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")}
    return edges.withColumns({f"_{k}": v for k, v in ends.items()}).groupBy(F.col("_src").alias("src"), F.col("_dst").alias("dst")).agg(
        F.min_by(F.struct(*rest), F.struct(F.col("edge_key") != 0, "edge_key")).alias("e")).select("src", "dst", "e.*")


def route_metrics(paths: DataFrame, edges: DataFrame, weight: str = "travel_time", parallel: str = "paid") -> DataFrame:
    """Distance, time, congestion and size of each route.

    Figures come from the edges the route paid for; ``parallel="first"`` takes
    the parallel edge with key 0 instead, whatever the path paid.
    """
    chosen = first_parallel(edges) if parallel == "first" else cheapest_edges(edges, weight)
    paid = chosen.select("src", "dst", "length_m", "travel_time", "congestion_level")
    steps = path_segments(paths).withColumns({"src": F.least("u", "v"), "dst": F.greatest("u", "v")})
    sums = steps.join(paid, ["src", "dst"]).groupBy("query_id").agg(
        F.sum("length_m").alias("m"), F.sum("travel_time").alias("s"),
        F.avg("congestion_level").alias("cong"), F.count(F.lit(1)).alias("segments_count"),
    )
    return sums.select(
        "query_id",
        round_even(F.col("m") / 1000.0, 2).alias("distance_km"),
        round_even(F.col("s") / 60.0, 1).alias("estimated_time_mins"),
        round_even("cong", 2).alias("avg_congestion_multiplier"),
        F.greatest("segments_count", F.lit(1)).cast("bigint").alias("segments_count"),
    )


def route_coords(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ordered ``[lon, lat]`` pairs of each route; one route fits one row."""
    from netresil.functions.projection import utm_to_wgs84

    lon, lat = utm_to_wgs84(F.col("x"), F.col("y"))
    pts = paths.join(nodes.select("node_id", "x", "y"), "node_id").select(
        "query_id", F.struct(F.col("seq"), F.array(lon, lat).alias("p")).alias("s")
    )
    return pts.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list("s")), lambda s: s["p"]).alias("route_coords")
    )


def route(od: DataFrame, nodes: DataFrame, edges: DataFrame, weight: str = "travel_time",
          adj: DataFrame | None = None) -> DataFrame:
    """Snapped requests -> one row each with status, message and metrics.

    ``src`` or ``dst`` is null where snapping failed. Nothing is raised.
    """
    ask = od.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    costs, paths = shortest_paths(ask, nodes, edges, weight, adj)
    met = route_metrics(paths, edges, weight).join(costs, "query_id")
    same = F.col("src") == F.col("dst")
    unsnapped = F.col("src").isNull() | F.col("dst").isNull()
    found = F.col("cost").isNotNull()
    return od.join(met, "query_id", "left").select(
        "query_id", "src", "dst",
        F.when(unsnapped, "error").when(same, "warning").when(found, "success").otherwise("error").alias("status"),
        F.when(unsnapped, "No road found near the location.").when(same, SAME_NODE)
        .when(~found, NO_PATH).alias("message"),
        F.when(same, 0.0).otherwise(F.col("distance_km")).alias("distance_km"),
        F.when(same, 0.0).otherwise(F.col("estimated_time_mins")).alias("estimated_time_mins"),
        F.when(same, 1.0).otherwise(F.col("avg_congestion_multiplier")).alias("avg_congestion_multiplier"),
        F.when(same, F.lit(0).cast("bigint")).otherwise(F.col("segments_count")).alias("segments_count"),
        F.when(same, 0.0).otherwise(F.col("cost")).alias("cost"),
    )


def nearest_outside(sources: DataFrame, nodes: DataFrame, edges: DataFrame, reach: float = BYPASS_REACH) -> DataFrame:
    """Fewest-hop node farther than ``reach`` radii from the zone's centre.

    ``sources(query_id, src, zx, zy, zr)`` -> ``(query_id, node_id, hops)``;
    ties by node id. Searched in blocks of the plane (see ``surroundings``);
    rounds of joins are left for blocks too dense for one task, queries given
    more than once with unlike places, and networks in which a node has no
    place or several.
    """
    places = cut_lineage(nodes.select("node_id", "x", "y").where(F.col("node_id").isNotNull()).distinct())
    firm = lambda *cols: F.forall(F.array(*[F.col(c).cast("double") for c in cols]), lambda v: v.isNotNull() & (F.abs(v) < 1e15))
    queries = cut_lineage(sources.select("query_id", "src", "zx", "zy", "zr").where(F.col("query_id").isNotNull()).distinct().withColumn(
        "number", F.monotonically_increasing_id()))
    repeated = places.groupBy("node_id").count().where(F.col("count") > 1)
    if not places.where(~firm("x", "y")).isEmpty() or not repeated.isEmpty():
        return _outside_by_rounds(queries, places, edges, reach)
    twice = cut_lineage(queries.groupBy("query_id").count().where(F.col("count") > 1).select("query_id"))
    once = queries.join(twice, "query_id", "left_anti")
    far = norm2(F.col("x") - F.col("zx"), F.col("y") - F.col("zy")) > F.col("zr") * reach
    began = cut_lineage(once.join(places, F.col("src") == F.col("node_id")).withColumn("hit", far))
    at_once = began.where("hit").select("query_id", "node_id", F.lit(0).alias("hops"))
    end = lambda c: places.select(F.col("node_id").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y"))
    pairs = undirected_pairs(drop_self_loops(edges)).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    streets = cut_lineage(pairs.join(end("a"), "a").join(end("b"), "b").select("a", "b", "ax", "ay", "bx", "by"))
    inner = began.where(~F.col("hit") & firm("zx", "zy", "zr"))
    found, left = hops_outside(inner.select("number", "src", "zx", "zy", (F.col("zr") * reach).alias("far")), streets)
    answers = at_once
    if found is not None:
        answers = answers.unionByName(queries.select("query_id", "number").join(found, "number").select("query_id", "node_id", "hops"))
    # without a place or a radius no node is outside, unless other rows of the query say so
    odd = queries.join(twice, "query_id", "left_semi").unionByName(queries.join(left.select("number"), "number", "left_semi").select(queries.columns))
    odd = odd.unionByName(began.where(~F.col("hit") & ~firm("zx", "zy", "zr") & far.isNotNull()).select(queries.columns))
    odd = cut_lineage(odd)
    if not odd.isEmpty():
        answers = answers.unionByName(_outside_by_rounds(odd, places, edges, reach))
    return cut_lineage(answers)


def _outside_by_rounds(sources: DataFrame, nodes: DataFrame, edges: DataFrame, reach: float) -> DataFrame:
    """``nearest_outside`` hop by hop: a query leaves the frontier at its first hit."""
    from netresil.operators.graph import both_ways

    adj = cut_lineage(both_ways(edges))
    xy = nodes.select(F.col("node_id").alias("node"), "x", "y")
    zone = cut_lineage(sources.select("query_id", "zx", "zy", "zr"))
    out_of_zone = norm2(F.col("x") - F.col("zx"), F.col("y") - F.col("zy")) > F.col("zr") * reach

    def judge(front):
        return front.join(xy, "node").join(zone, "query_id").select(
            "query_id", "node", "hops", out_of_zone.alias("hit")
        )

    start = sources.select("query_id", F.col("src").alias("node"), F.lit(0).alias("hops"))
    seen = cut_lineage(judge(start))
    front = seen
    answers = None
    hops = 0
    while True:
        hits = front.where("hit").groupBy("query_id").agg(F.min("node").alias("node_id"), F.min("hops").alias("hops"))
        answers = hits if answers is None else answers.unionByName(hits)
        alive = front.join(hits.select("query_id"), "query_id", "left_anti")
        hops += 1
        nxt = alive.join(adj, F.col("node") == F.col("src")).select("query_id", F.col("dst").alias("node")).distinct()
        nxt = nxt.join(seen, ["query_id", "node"], "left_anti").withColumn("hops", F.lit(hops))
        front = cut_lineage(judge(nxt))
        if front.limit(1).count() == 0:
            return cut_lineage(answers)
        seen = seen.unionByName(front)
        if hops % 16 == 0:
            seen = cut_lineage(seen)


def demo_waypoints(members: DataFrame) -> DataFrame:
    """First and middle node of the largest component, by node id."""
    # dense positions without a global window: range-sort, then count per task
    n = members.agg(F.count(F.lit(1)).alias("n"))
    ranked = positions(members)
    return ranked.join(F.broadcast(n)).where(  # one row
        (F.col("pos") == 0) | (F.col("pos") == F.floor(F.col("n") / 2))
    ).select("node_id", "pos")


def positions(ids: DataFrame, column: str = "node_id") -> DataFrame:
    """Dense position of each id in ascending order.

    Two steps so that no single task sorts everything: ids are counted per
    bucket of a range partitioning, offsets come from the bucket totals.
    """
    return ranked(ids.select(column), [column])


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows with their dense position ``pos`` in ascending ``order``.

    The rows themselves travel, so nothing is joined back and ties can't
    multiply them; a hash of all columns orders equal ones.
    """
    tie = F.xxhash64(*rows.columns)
    by = [F.col(c) for c in order]
    parts = rows.withColumn("_h", tie).repartitionByRange(*by, F.col("_h")).withColumn("_p", F.spark_partition_id())
    parts = cut_lineage(parts)
    totals = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    from pyspark.sql import Window

    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("_p", F.coalesce(before, F.lit(0)).alias("_off"))  # one row per partition
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*by, "_h")) - 1
    return parts.withColumn("_i", local).join(F.broadcast(offsets), "_p").select(
        *rows.columns, (F.col("_off") + F.col("_i")).cast("bigint").alias("pos")
    )
