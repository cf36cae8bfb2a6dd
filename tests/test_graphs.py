import math
import random

import numpy as np
import pytest
from brute import betweenness as exact_betweenness
from brute import components, cores, dijkstra, kruskal, segment_distance
from pyspark.sql import functions as F

from netresil.operators import graph as GR
from netresil.operators import components as CC
from netresil.operators import tiles, trips
from netresil.operators.centrality import betweenness
from netresil.operators.components import component_sizes, connected_components, network_summary
from netresil.operators.healing import max_spanning_bridges
from netresil.operators.routing import nearest_outside, positions, route, shortest_paths
from netresil.operators.blocks import labels
from netresil.plans import impact as IM
from netresil.plans.impact import compare_routes, impact


def edges_df(spark, edges):
    return spark.createDataFrame([(u, v, float(w), float(w) / 11.1, 1.0) for u, v, w in edges],
                                 "src long, dst long, length_m double, travel_time double, congestion_level double")


def nodes_df(spark, xy):
    return spark.createDataFrame([(n, float(x), float(y)) for n, (x, y) in xy.items()], "node_id long, x double, y double")


def lattice(side, keep, seed, step=100):
    """Part of a square lattice: coordinates and weighted edges."""
    rnd = random.Random(seed)
    xy = {r * side + c: (c * step + rnd.randint(-20, 20), r * step + rnd.randint(-20, 20)) for r in range(side) for c in range(side)}
    edges = []
    for n in xy:
        for m, ok in ((n + 1, n % side < side - 1), (n + side, n // side < side - 1)):
            if ok and rnd.random() < keep:
                d = ((xy[n][0] - xy[m][0]) ** 2 + (xy[n][1] - xy[m][1]) ** 2) ** 0.5
                edges.append((n, m, int(d * (1 + rnd.random())) + 1))
    return xy, edges


@pytest.mark.parametrize("edges", [
    [(0, 1), (1, 2), (2, 3), (3, 4)],
    [(0, 1), (1, 2), (2, 3), (3, 0)],
    [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3)],
    [(0, 1), (2, 3)],
    [(7, 0), (7, 1), (7, 2), (7, 3), (7, 4), (7, 5), (7, 6)],
])
def test_components_of_micro_graphs(spark, edges):
    nodes = range(9)
    got = connected_components(spark.createDataFrame([(n,) for n in nodes], "node_id long"), spark.createDataFrame(edges, "src long, dst long"))
    assert {r.node_id: r.component for r in got.collect()} == components(nodes, edges)


def test_components_random_and_repartitioned(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)]
    want = components(range(300), edges)
    nodes = spark.range(300).withColumnRenamed("id", "node_id")
    for parts in (1, 7):
        got = connected_components(nodes, spark.createDataFrame(edges, "src long, dst long").repartition(parts))
        assert {r.node_id: r.component for r in got.collect()} == want


@pytest.mark.parametrize("stop", [0, 40])
def test_components_of_contracted_graphs(spark, monkeypatch, stop):
    monkeypatch.setattr(CC, "STAR_EDGES", stop)
    rnd = random.Random(3)
    n = 300
    edges = [(rnd.randrange(n), rnd.randrange(n), 1.0) for _ in range(170)] + [(i, i + 1, 1.0) for i in range(400, 460)]
    edges += [(500, 600 + i, 1.0) for i in range(50)] + [(7, 7, 1.0), (8, 9, 1.0), (9, 8, 1.0)]
    ids = [*range(n), *range(400, 461), 500, *range(600, 650)]
    nodes = spark.createDataFrame([(i,) for i in ids], "node_id long")
    got = {r["node_id"]: r["component"] for r in connected_components(nodes, edges_df(spark, edges)).collect()}
    want = components(ids, [(u, v) for u, v, _ in edges])
    assert got == want
    keyed = edges_df(spark, edges).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).where("k = 1 or src <> 410")
    got = CC.star_labels(keyed, ["k"]).collect()
    assert {(r["node_id"]): r["component"] for r in got if r["k"] == 1} == {u: c for u, c in want.items() if any(u in (a, b) and a != b for a, b, _ in edges)}
    assert {r["component"] for r in got if r["k"] == 2 and 400 <= r["node_id"] <= 460} == {400, 411}


def test_keyed_components_with_a_hub(spark):
    a = [(1, 0, n) for n in range(1, 200)]
    b = [(2, n, n + 1) for n in range(50)]
    n = spark.createDataFrame([(1, i) for i in range(200)] + [(2, i) for i in range(60)], "k long, node_id long")
    got = component_sizes(connected_components(n, spark.createDataFrame(a + b, "k long, src long, dst long"), ["k"]), ["k"])
    assert sorted((r.k, r.nodes) for r in got.collect()) == [(1, 200)] + [(2, 1)] * 9 + [(2, 51)]


def test_components_joined_by_more_edges(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(90)]
    more = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(40)] + [(5, 5)]
    nodes, as_df = spark.range(200).withColumnRenamed("id", "node_id"), lambda e: spark.createDataFrame(e, "src long, dst long")
    got = CC.joined_components(connected_components(nodes, as_df(edges)), as_df(more))
    assert {r.node_id: r.component for r in got.collect()} == components(range(200), edges + more)


def test_core_numbers(spark):
    xy, edges = lattice(9, 0.8, 1)
    edges += [(n, n + 10, 5) for n in range(0, 60, 3)]
    got = GR.core_number(nodes_df(spark, xy), edges_df(spark, edges))
    assert {r.node_id: r.core_number for r in got.collect()} == cores(list(xy), [e[:2] for e in edges])


def test_core_rounds_look_only_where_something_fell(spark, monkeypatch):
    looked = []

    class Counted(GR.Rounds):
        def cut(self, *frames):
            out = super().cut(*frames)
            looked.extend(df.count() for df in out if df.columns == ["src"])
            return out

    monkeypatch.setattr(GR, "Rounds", Counted)
    xy = {n: (n, 0) for n in range(11)}
    got = GR.core_number(nodes_df(spark, xy), edges_df(spark, [(n, n + 1, 1) for n in range(10)]))
    assert {r.core_number for r in got.collect()} == {1}
    assert len(looked) > 2 and max(looked) <= 4


def test_bridges_equal_kruskal(spark):
    rnd = random.Random(5)
    nodes = list(range(60))
    base = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(25)]
    cands = {}
    for _ in range(150):
        i, j = sorted(rnd.sample(nodes, 2))
        cands[(i, j)] = rnd.choice([0.4, 0.5, 0.6, 0.7, 0.8])
    rows = [(s, i, j) for (i, j), s in cands.items()]
    n = spark.createDataFrame([(k,) for k in nodes], "node_id long")
    b = spark.createDataFrame(base, "src long, dst long")
    got = max_spanning_bridges(spark.createDataFrame(rows, "score double, ni long, nj long"), connected_components(n, b))
    pairs = {(r.ni, r.nj) for r in got.collect()}
    assert pairs == kruskal(nodes, base, rows)
    # exactly as many bridges as components disappear
    before = len(set(components(nodes, base).values()))
    assert len(pairs) == before - len(set(components(nodes, base + list(pairs)).values()))


def test_a_street_goes_to_fewer_than_two_blocks(spark, monkeypatch):
    sent, cut = [], trips.cut_lineage

    def kept(df):
        out = cut(df)
        if {"parts", "w"} <= set(df.columns):
            sent.append(out.count())
        return out

    monkeypatch.setattr(trips, "cut_lineage", kept)
    monkeypatch.setattr(trips, "LEAST_SIDE", 512.0)
    xy, edges = lattice(40, 0.9, 3)
    od = spark.createDataFrame([(n, n, n + 1) for n in xy if n % 40 < 39], "query_id long, src long, dst long")
    costs, _ = shortest_paths(od, nodes_df(spark, xy), edges_df(spark, edges), "length_m")
    assert costs.count() > 1400 and sent[0] < 2.4 * len(edges)  # at this small side one street in six crosses a border


def test_enough_blocks_are_not_sent_once_per_few_trips(spark, monkeypatch):
    sent, cut = [], trips.cut_lineage
    monkeypatch.setattr(trips, "cut_lineage", lambda df: sent.append(cut(df)) or sent[-1])
    for name, value in (("BLOCK_TRIPS", 16), ("TASKS_PER_CORE", 0)):
        monkeypatch.setattr(trips, name, value, raising=False)
    xy, edges = lattice(15, 0.9, 3)
    od = spark.createDataFrame([(n, n, n + 1) for n in xy if n % 15 < 14], "query_id long, src long, dst long")
    got, _ = shortest_paths(od, nodes_df(spark, xy), edges_df(spark, edges), "length_m")
    want = {n: dijkstra(edges, n).get(n + 1) for n in xy if n % 15 < 14}
    assert {r.query_id: r.cost for r in got.collect()} == {k: v for k, v in want.items() if v is not None}
    copies = next(df for df in sent if {"parts", "w"} <= set(df.columns))
    assert copies.selectExpr("max(parts)").first()[0] == 1


@pytest.mark.parametrize("limits", [(1 << 18, 256, 2048.0), (1 << 18, 2, 64.0), (40, 256, 64.0), (0, 256, 64.0)])
def test_paths_match_dijkstra_with_and_without_zones(spark, monkeypatch, limits):
    # one block; blocks grown around each trip; some, then all trips left to the rounds
    for name, value in zip(("BLOCK_STREETS", "BLOCK_TRIPS", "LEAST_SIDE"), limits):
        monkeypatch.setattr(trips, name, value)
    xy, edges = lattice(12, 0.75, 7)
    rnd = random.Random(11)
    zone = (550.0, 550.0, 180.0)
    od = [(q, rnd.randrange(144), rnd.randrange(144)) for q in range(12)]
    od = [t for t in od if t[1] != t[2]]
    rows = [(q, s, d, None, None, None) for q, s, d in od] + [(q + 100, s, d, *zone) for q, s, d in od]
    df = spark.createDataFrame(rows, "query_id long, src long, dst long, zx double, zy double, zr double")
    costs, paths = shortest_paths(df, nodes_df(spark, xy), edges_df(spark, edges), "length_m")
    got = {r.query_id: r.cost for r in costs.collect()}
    shut = lambda u, v: segment_distance(zone[0], zone[1], *xy[u], *xy[v]) <= zone[2]
    want = {}
    for q, s, d in od:
        for k, closed in ((q, lambda u, v: False), (q + 100, shut)):
            c = dijkstra(edges, s, closed).get(d)
            if c is not None:
                want[k] = c
    assert got == want
    assert all(got[q + 100] >= got[q] for q, _, _ in od if q + 100 in got)
    best = {}
    for u, v, w in edges:
        best[u, v] = best[v, u] = w
    trail = {}
    for r in paths.orderBy("query_id", "seq").collect():
        trail.setdefault(r.query_id, []).append(r.node_id)
    assert {q: sum(best[a, b] for a, b in zip(t, t[1:])) for q, t in trail.items()} == want


@pytest.mark.parametrize("radius, want", [(60.0, "cut off"), (450.0, "cut off"), (30.0, "found")])
def test_a_goal_cut_off_among_few_nodes_does_not_cost_the_block(monkeypatch, radius, want):
    """Its own streets fail, or those of a ring around it with streets left inside; with a smaller zone one street stays open."""
    import pandas as pd
    from netresil.operators import trips
    side, looked, left = 60, [], trips._Ways.left
    monkeypatch.setattr(trips._Ways, "left", lambda *a: looked.append(1) or left(*a))
    at = lambda n: (float(n % side * 100), float(n // side * 100))
    goal, rows = 30 * side + 30, []
    for n in range(side * side):
        for m in ([n + 1] if n % side < side - 1 else []) + ([n + side] if n // side < side - 1 else []):
            rows.append((True, n, m, 0, 100.0, *at(n), *at(m), None, None, None, True, True))
    x, y = at(goal)
    if want == "found":
        y -= 60.0  # one of the four streets of the goal
    # the ring is made of the zone's streets, the goal's neighbours inside it get ways of their own
    extra = [] if radius < 100 else [(goal, 10**6), (10**6, 10**6 + 1), (10**6 + 1, goal)]
    rows += [(True, a, b, 0, 100.0, 9e5, 9e5, 9e5 + 1, 9e5, None, None, None, True, True) for a, b in extra]
    rows.append((False, 0, goal, 7, None, *at(0), *at(goal), x, y, radius, True, True))
    table = pd.DataFrame(rows, columns=["street", "a", "b", "number", "w", "x0", "y0", "x1", "y1", "zx", "zy", "zr", "from_u", "from_v"])
    out = trips._answer(table, 1.0).iloc[0]
    assert out["number"] == 7
    if want == "found":
        assert out["outcome"] == trips.FOUND and out["cost"] == 6000.0 and len(out["path"]) == 61
    else:
        assert out["outcome"] == trips.NO_PATH and len(looked) < 200


def test_a_trip_that_leaves_its_first_block(spark):
    # the short way round leads far outside; 4 is a pocket of its own
    xy = {0: (0, 0), 1: (50, 0), 2: (0, 5000), 3: (50, 5000), 4: (25, 10), 5: (26, 12), 6: (30, 0)}
    edges = [(0, 2, 5000), (2, 3, 50), (3, 1, 5000), (4, 5, 3)]
    od = spark.createDataFrame([(1, 0, 1), (2, 0, 4), (3, 4, 0), (4, 0, 6), (5, 6, 0), (6, 4, 5)], "query_id long, src long, dst long")
    costs, paths = shortest_paths(od, nodes_df(spark, xy), edges_df(spark, edges), "length_m")
    assert {r.query_id: r.cost for r in costs.collect()} == {1: 10050.0, 6: 3.0}
    assert [r.node_id for r in paths.where("query_id = 1").orderBy("seq").collect()] == [0, 2, 3, 1]


def test_route_statuses(spark):
    xy = {0: (0, 0), 1: (100, 0), 2: (200, 0), 9: (900, 0)}
    e = edges_df(spark, [(0, 1, 150), (0, 1, 120), (1, 2, 100)])
    od = spark.createDataFrame([(1, 0, 2), (2, 1, 1), (3, 0, 9), (4, None, 2)], "query_id long, src long, dst long")
    got = {r.query_id: r for r in route(od, nodes_df(spark, xy), e, "length_m").collect()}
    assert {q: r.status for q, r in got.items()} == {1: "success", 2: "warning", 3: "error", 4: "error"}
    assert got[1].cost == 220 and got[1].distance_km == 0.22 and got[1].segments_count == 2
    with pytest.raises(ValueError):
        route(od, nodes_df(spark, xy), e, "no_such_weight")


def test_betweenness_exact(spark):
    xy, edges = lattice(5, 0.85, 2)
    got = betweenness(nodes_df(spark, xy), edges_df(spark, edges), 10**6)
    want = exact_betweenness(list(xy), edges)
    assert {r.node_id: round(r.betweenness, 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items()}


def test_betweenness_of_a_path(spark):
    n = 6
    xy = {i: (i * 100, 0) for i in range(n)}
    got = betweenness(nodes_df(spark, xy), edges_df(spark, [(i, i + 1, 100) for i in range(n - 1)]), n)
    want = {i: 2 * i * (n - 1 - i) / ((n - 1) * (n - 2)) for i in range(n)}
    assert {r.node_id: round(r.betweenness, 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items()}


def test_betweenness_takes_no_round_per_street(spark, monkeypatch):
    """A round of tiles costs one table or two; the 80 streets of the snake are passed in a few of them."""
    from netresil.operators import centrality
    n, written = 81, []
    xy = {i: (i * 100, 0) for i in range(n)}
    cut = tiles.cut_lineage
    for m in (tiles, centrality):
        monkeypatch.setattr(m, "cut_lineage", lambda df: written.append(1) or cut(df))
    monkeypatch.setattr(tiles, "TILE_NODES", 25)
    got = betweenness(nodes_df(spark, xy), edges_df(spark, [(i, i + 1, 100) for i in range(n - 1)]), n)
    want = {i: 2 * i * (n - 1 - i) / ((n - 1) * (n - 2)) for i in range(n)}
    assert {r.node_id: round(r.betweenness, 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items()}
    assert len(written) < 30


@pytest.mark.parametrize("limits", [(7, 2)])
def test_betweenness_over_many_tiles(spark, monkeypatch, limits):
    monkeypatch.setattr(tiles, "TILE_NODES", limits[0])
    monkeypatch.setattr(tiles, "TASK_QUERIES", limits[1])
    xy, edges = lattice(5, 0.85, 7)
    edges = [(u, v, 100 + w % 2) for u, v, w in edges]  # many ways of one length
    got = betweenness(nodes_df(spark, xy), edges_df(spark, edges), 10**6)
    want = exact_betweenness(list(xy), edges)
    assert {r.node_id: round(r.betweenness, 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items()}


def test_betweenness_of_a_network_that_fits_a_task_takes_no_rounds(spark, monkeypatch):
    from netresil.operators import centrality, pivots
    xy, edges = lattice(9, 0.85, 3)
    edges = [(u, v, 100 + w % 2) for u, v, w in edges]
    written, cut = [], centrality.cut_lineage
    for m in (tiles, centrality):
        monkeypatch.setattr(m, "cut_lineage", lambda df: written.append(1) or cut(df))
    monkeypatch.setattr(tiles, "TILE_NODES", 7)
    # several tasks, each of which works on a few pivots at a time
    monkeypatch.setattr(pivots, "TASK_PIVOTS", 20)
    monkeypatch.setattr(pivots, "AT_ONCE", 300)
    got = betweenness(nodes_df(spark, xy), edges_df(spark, edges), 10**6)
    want = exact_betweenness(list(xy), edges)
    assert {r.node_id: round(r.betweenness, 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items()}
    assert len(written) <= 3


@pytest.mark.parametrize("pivots", [10**6, 11])
def test_betweenness_whole_and_in_tiles_agree(spark, monkeypatch, pivots):
    """Also with streets without length, ids beyond 2^53, nodes given twice or without an id, and pieces that are not joined."""
    from netresil.operators import centrality
    xy, edges = lattice(6, 0.7, 8)
    far = 1 << 60
    e = [(far + u, far + v, 0 if (u + v) % 11 == 0 else 100 + w % 2) for u, v, w in edges]
    n = spark.createDataFrame([(far + k, float(x), float(y)) for k, (x, y) in xy.items()] + [(far + 3, 3.0, 4.0), (None, 1.0, 1.0)], "node_id long, x double, y double")
    answers = []
    for whole in (1 << 20, 0):
        monkeypatch.setattr(centrality, "WHOLE_STREETS", whole)
        monkeypatch.setattr(tiles, "TILE_NODES", 7)
        answers.append(sorted((r.node_id or 0, round(r.betweenness, 9)) for r in betweenness(n, edges_df(spark, e), pivots).collect()))
    assert answers[0] == answers[1] and len(answers[0]) == len(xy) + 2 and any(b for _, b in answers[0])


@pytest.mark.parametrize("limits", [(1 << 19, 1024), (1 << 19, 7), (150, 7), (30, 7)])
def test_impact_against_recomputing_everything(spark, monkeypatch, limits):
    # all in one task, in several, in blocks that fit a task, and in some that never do
    monkeypatch.setattr(IM, "BLOCK_EDGES", limits[0])
    monkeypatch.setattr(IM, "BLOCK_INCIDENTS", limits[1])
    xy, edges = lattice(16, 0.7, 4)
    rnd = random.Random(9)
    inc = [(i, rnd.uniform(-100, 1700), rnd.uniform(-100, 1700), rnd.choice([20.0, 90.0, 160.0])) for i in range(25)]
    got = {r.incident_id: r for r in impact(
        spark.createDataFrame(inc, "incident_id long, x double, y double, radius_m double"), nodes_df(spark, xy), edges_df(spark, edges)).collect()}
    n = len(xy)
    for i, x, y, rad in inc:
        gone = [(u, v) for u, v, _ in edges if segment_distance(x, y, *xy[u], *xy[v]) <= rad]
        left = [(u, v) for u, v, _ in edges if (u, v) not in set(gone)]
        comp = list(components(list(xy), left).values())
        sizes = {c: comp.count(c) for c in set(comp)}
        r = got[i]
        assert r.edges_removed == len(gone)
        assert r.components_after == len(sizes), i
        assert abs(r.connectivity_after - 100 * max(sizes.values()) / n) < 0.006
        assert r.nodes_in_zone == sum((px - x) ** 2 + (py - y) ** 2 <= rad * rad for px, py in xy.values())


def test_streets_are_not_sent_once_per_few_incidents(spark, monkeypatch):
    """Many incidents in one block: it is split further instead of being copied for every few of them."""
    monkeypatch.setattr(IM, "BLOCK_EDGES", 700)
    monkeypatch.setattr(IM, "BLOCK_INCIDENTS", 2)
    copies, in_tasks = [], IM._in_tasks

    def counted(placed, graph, *rest):
        key = ["bx_", "by_"]
        asked = placed.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / 2).alias("parts"))
        sent, once = graph.groupBy(*key).count().join(asked, key).agg(F.sum(F.col("count") * F.col("parts")), F.sum("count")).first()
        copies.append(sent / once)
        return in_tasks(placed, graph, *rest)

    monkeypatch.setattr(IM, "_in_tasks", counted)
    xy, edges = lattice(22, 0.9, 5)
    rnd = random.Random(2)
    inc = [(i, rnd.uniform(0, 2100), rnd.uniform(0, 2100), 20.0) for i in range(200)]
    got = impact(spark.createDataFrame(inc, "incident_id long, x double, y double, radius_m double"), nodes_df(spark, xy), edges_df(spark, edges)).collect()
    assert len(got) == 200 and len(copies) == 1 and copies[0] <= IM.MOST_COPIES


def test_zones_of_like_sizes_take_one_pass(spark, monkeypatch):
    """Sizes are classed from the largest down, so that 200 and 300 metres are not torn apart by a power of sixteen."""
    monkeypatch.setattr(IM, "BLOCK_EDGES", 150)
    passes, divided = [], IM._divided
    monkeypatch.setattr(IM, "_divided", lambda inc, *rest: passes.append(inc.count()) or divided(inc, *rest))
    xy, edges = lattice(12, 0.8, 6)
    inc = spark.createDataFrame([(1, 300.0, 300.0, 200.0), (2, 700.0, 800.0, 300.0), (3, 500.0, 500.0, 10.0)], "incident_id long, x double, y double, radius_m double")
    got = {r.incident_id: r.edges_removed for r in impact(inc, nodes_df(spark, xy), edges_df(spark, edges)).collect()}
    assert sorted(passes) == [1, 2]
    assert got == {i: sum(segment_distance(x, y, *xy[u], *xy[v]) <= r for u, v, _ in edges) for i, x, y, r in inc.collect()}


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_labels_square_by_square_are_those_of_the_whole(spark, monkeypatch, most):
    """Several graphs at once, large ids, streets without a place, squares that fit and squares that are halved."""
    from netresil.operators import plane
    monkeypatch.setattr(plane, "LABEL_EDGES", most)
    rnd, big = random.Random(4), 1 << 60
    xy = {i: (rnd.uniform(0, 1000) * rnd.random(), rnd.uniform(0, 1000)) for i in range(300)}
    e = [(i, j) for i in xy for j in xy if i < j and (xy[i][0] - xy[j][0]) ** 2 + (xy[i][1] - xy[j][1]) ** 2 < 45**2]
    rows = [(i % 2, big + i, big + j, *(xy[i] if i % 9 else (None, float("nan")))) for i, j in e]
    got = plane.plane_labels(spark.createDataFrame(rows, "k long, src long, dst long, x double, y double"), ["k"]).collect()
    want = {}
    for k in (0, 1):
        own = [p for p in e if p[0] % 2 == k]
        want |= {(k, n): c for n, c in components({n for p in own for n in p}, own).items()}
    assert {(r.k, r.node_id - big): r.component - big for r in got} == want and len(got) == len(want)


def test_impact_on_the_street_network(spark):
    """All incidents of the given tables, against union-find over the whole network."""
    from checks.fixtures import fx
    sf = "/root/testdata/sf0.001"
    xy = {r.node_id: (r.x, r.y) for r in fx(spark, sf, "fx_nodes").collect()}
    pairs = [(r.src, r.dst) for r in fx(spark, sf, "fx_edges").select("src", "dst").distinct().collect()]
    place = {n: i for i, n in enumerate(xy)}
    u, v = ([place[p[k]] for p in pairs] for k in (0, 1))
    ax, ay, bx, by = (np.array([xy[p[k]][c] for p in pairs]) for k, c in ((0, 0), (0, 1), (1, 0), (1, 1)))
    u, v = np.array(u), np.array(v)
    got = {r.incident_id: r for r in impact(fx(spark, sf, "fx_incidents"), fx(spark, sf, "fx_nodes"), fx(spark, sf, "fx_edges")).collect()}
    incidents = fx(spark, sf, "fx_incidents").collect()
    assert len(got) == len(incidents)
    for i in incidents:
        t = np.clip(((i.x - ax) * (bx - ax) + (i.y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2), 0, 1)
        left = np.hypot(ax + t * (bx - ax) - i.x, ay + t * (by - ay) - i.y) > i.radius_m
        size = np.bincount(labels(len(xy), u[left], v[left]), minlength=len(xy))
        r = got[i.incident_id]
        assert (r.edges_removed, r.components_after) == ((~left).sum(), (size > 0).sum())
        assert r.connectivity_after == round(size.max() / len(xy) * 100, 2)


def test_labels_are_the_smallest_members():
    r = np.random.default_rng(4)
    for n in (1, 2, 30, 200):
        for m in (0, n // 2, 2 * n):
            e = r.integers(0, n, (m, 2))
            want = components(range(n), [tuple(x) for x in e.tolist()])
            assert labels(n, e[:, 0], e[:, 1]).tolist() == [want[i] for i in range(n)]
    chain = r.permutation(1000)
    assert (labels(1000, chain[:-1], chain[1:]) == 0).all()


def test_bypass_accepts_node_zero_and_isolation(spark):
    # 0 - 1 - 2 - 3 - 4 with the zone on node 4's only street; 0 is the way out
    xy = {0: (0, 0), 1: (100, 0), 2: (200, 0), 3: (300, 0), 4: (400, 0), 8: (400, 60)}
    e = edges_df(spark, [(0, 1, 100), (1, 2, 100), (2, 3, 100), (3, 4, 100), (4, 8, 60)])
    req = [(1, 400.0, 0.0, 50.0, 0.0, 0.0, 400.0, 60.0), (2, 1000.0, 0.0, 50.0, 0.0, 0.0, 300.0, 0.0), (3, 400.0, 0.0, 50.0, 9000.0, 0.0, 0.0, 0.0)]
    got = {r.query_id: r for r in compare_routes(
        spark.createDataFrame(req, "query_id long, x double, y double, radius_m double, sx double, sy double, ex double, ey double"), nodes_df(spark, xy), e, 500.0).collect()}
    assert got[1].normal_status == "success" and got[1].safe_status == "success" and got[1].note
    assert got[2].safe_status == "success" and got[2].detour_km == 0.0 and got[2].note is None
    assert got[3].normal_status == "error" and got[3].safe_status == "error"


def test_nearest_outside_ties_by_id(spark):
    xy = {0: (0, 0), 1: (500, 0), 2: (-500, 0), 3: (900, 0)}
    e = edges_df(spark, [(0, 1, 500), (0, 2, 500), (1, 3, 400)])
    src = spark.createDataFrame([(5, 0, 0.0, 0.0, 100.0)], "query_id long, src long, zx double, zy double, zr double")
    assert [tuple(r) for r in nearest_outside(src, nodes_df(spark, xy), e).collect()] == [(5, 1, 1)]


def test_parallel_edges(spark):
    e = spark.createDataFrame([(1, 2, 0, 50.0), (1, 2, 1, 40.0), (2, 1, 3, 60.0), (2, 3, 2, 10.0)], "src long, dst long, edge_key int, length_m double")
    assert {(r.src, r.dst): r.length_m for r in GR.cheapest_edges(e, "length_m").collect()} == {(1, 2): 40.0, (2, 3): 10.0}
    assert {(r.src, r.dst): r.edge_key for r in GR.keyed_edges(e).collect()} == {(1, 2): 0, (2, 3): 2}
    failed = spark.createDataFrame([(2, 1)], "src long, dst long")
    assert GR.remove_edges(e, failed).count() == 1
    assert GR.remove_one_parallel(e, failed).count() == 3


def test_summary_counts_isolated_nodes(spark):
    n = spark.range(5).withColumnRenamed("id", "node_id")
    e = edges_df(spark, [(0, 1, 1000), (1, 2, 500)])
    r = network_summary(n, e, connected_components(n, e)).first()
    assert (r.nodes, r.edges, r.components, r.largest, r.total_km, r.connectivity, r.resilience) == (5, 2, 3, 3, 1.5, 60.0, 0.4)


def test_positions_are_dense(spark):
    ids = spark.range(0, 5000, 3).select((F.col("id") * 7 % 4999).alias("node_id")).distinct()
    got = [(r.pos, r.node_id) for r in positions(ids).orderBy("pos").collect()]
    assert [p for p, _ in got] == list(range(len(got)))
    assert [n for _, n in got] == sorted(n for _, n in got)


def test_nearest_outside_in_blocks_equals_a_search(spark, monkeypatch):
    from netresil.operators import routing as RT
    from netresil.operators import surroundings as SU
    xy, edges = lattice(14, 0.6, 11)
    xy[500], xy[501] = (650, 650), (12000, 650)  # one without a street, one whose only street leads far away
    edges += [(501, 3, 9000), (7, 7, 10)]
    near = {}
    for a, b, _ in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    rnd = random.Random(3)
    asked = [(i, rnd.randrange(196), rnd.uniform(-100, 1400), rnd.uniform(-100, 1400), rnd.choice([30.0, 150.0, 300.0, 900.0])) for i in range(60)]
    asked += [(90, 500, 650.0, 650.0, 40.0), (91, 999, 0.0, 0.0, 40.0), (92, 5, 0.0, 0.0, None), (93, None, 0.0, 0.0, 50.0), (94, 3, 400.0, 0.0, 3000.0)]
    asked += [(95, 20, 600.0, 100.0, 200.0)] * 2 + [(96, 20, 600.0, 100.0, 200.0), (96, 150, 1000.0, 1000.0, 200.0)]

    def search(rows):
        front, seen = {s for _, s, *_ in rows if s in xy}, set()
        for hops in range(1000):
            hit = [n for n in front if any(r is not None and math.hypot(xy[n][0] - x, xy[n][1] - y) > 3 * r for _, _, x, y, r in rows)]
            if hit or not front:
                return (min(hit), hops) if hit else None
            seen |= front
            front = {m for n in front for m in near.get(n, ())} - seen

    want = {q: search([r for r in asked if r[0] == q]) for q in {r[0] for r in asked}}
    want = {q: w for q, w in want.items() if w}
    src = spark.createDataFrame(asked, "query_id long, src long, zx double, zy double, zr double")
    rounds = []
    by_rounds = RT._outside_by_rounds
    monkeypatch.setattr(RT, "_outside_by_rounds", lambda q, *rest: rounds.append({r.query_id for r in q.collect()}) or by_rounds(q, *rest))
    for streets, spared in ((1 << 18, {96}), (60, None)):  # the second: some blocks are too dense
        monkeypatch.setattr(SU, "BLOCK_STREETS", streets)
        got = nearest_outside(src, nodes_df(spark, xy), edges_df(spark, edges)).collect()
        assert {r.query_id: (r.node_id, r.hops) for r in got} == want and len(got) == len(want)
        assert spared is None or rounds == [spared]  # all others are settled in their blocks
    assert len(rounds[-1]) > 1
    # a node at two places at once: as before, one of them is enough
    n = nodes_df(spark, xy).unionByName(spark.createDataFrame([(21, 5000.0, 0.0)], "node_id long, x double, y double"))
    one = spark.createDataFrame([(1, 21, 700.0, 100.0, 100.0)], "query_id long, src long, zx double, zy double, zr double")
    assert [tuple(r) for r in nearest_outside(one, n, edges_df(spark, edges)).collect()] == [(1, 21, 0)]
