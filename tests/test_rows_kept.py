"""Rows neither multiply nor vanish: ties, missing values, far points, own limits."""

import os

from pyspark.sql import functions as F

from netresil.functions.projection import utm_to_wgs84
from netresil.operators import learning as L
from netresil.operators import routing as RT
from netresil.operators import spatial as S
from netresil.operators.centrality import betweenness
from netresil.plans.requests import answer_routes, simulate
from netresil.session import Rounds, Scratch

SF = "/root/testdata/sf0.001"


def line(spark, n, missing=()):
    nodes = spark.createDataFrame([(i, 250000.0 + 100 * i, 2540000.0) for i in range(n)], "node_id bigint, x double, y double")
    edges = spark.createDataFrame(
        [(i, i + 1, None if i in missing else 100.0, 10.0, 1.5, 0) for i in range(n - 1)],
        "src bigint, dst bigint, length_m double, travel_time double, congestion_level double, edge_key int")
    return nodes, edges


def test_splits_are_exact_under_ties(spark):
    df = spark.createDataFrame([(i % 10, i) for i in range(100)], "k int, v int")
    got = L.split3(df, ["k"])
    assert got.count() == 100 and got.select("v").distinct().count() == 100
    assert {r["split"]: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 70, "val": 15, "test": 15}
    assert sorted(r["k"] for r in L.first_by_order(df, ["k"], 15).collect()) == [0] * 10 + [1] * 5
    same = spark.createDataFrame([(1, 1)] * 20, "k int, v int")
    assert L.first_by_order(same, ["k"], 7).count() == 7
    labelled = df.withColumn("label", (F.col("v") % 5 == 0).cast("int"))
    assert {r["label"]: r["count"] for r in L.balance(labelled, "label", ["k"]).groupBy("label").count().collect()} == {1: 20, 0: 60}


def test_edges_without_a_weight_do_not_wipe_distances(spark):
    nodes, edges = line(spark, 4)
    broken = edges.unionByName(spark.createDataFrame([(0, 3, None, 1.0, 1.0, 0)], edges.schema))
    adj = RT.adjacency(nodes, broken, "length_m")
    od = spark.createDataFrame([(1, 0)], "query_id bigint, src bigint")
    assert {r["node"]: r["dist"] for r in RT.search_all(od, adj).collect()} == {0: 0.0, 1: 100.0, 2: 200.0, 3: 300.0}
    assert {r["node_id"]: round(r["betweenness"], 6) for r in betweenness(nodes, broken, 4).collect()} == {0: 0.0, 1: 0.666667, 2: 0.666667, 3: 0.0}


def test_every_point_gets_a_member_or_an_error(spark):
    nodes, _ = line(spark, 300)
    members = spark.createDataFrame([(299,)], "node_id bigint")
    points = spark.createDataFrame([(i, 250000.0 + i, 2540000.0) for i in range(5)], "point_id bigint, x double, y double")
    got = S.random_near(points, nodes, members).collect()
    assert len(got) == 5 and {(r["node_id"], r["status"]) for r in got} == {(299, "success")}
    none = S.random_near(points, nodes, members.limit(0)).collect()
    assert len(none) == 5 and {(r["node_id"], r["status"]) for r in none} == {(None, "error")}


def test_each_request_has_its_own_snap_limit(spark):
    nodes, _ = line(spark, 3)
    points = spark.createDataFrame([(1, 250000.0, 2540300.0, 500.0), (2, 250000.0, 2540300.0, 200.0)], "point_id bigint, x double, y double, max_snap_dist_m double")
    got = {r["point_id"]: (r["node_id"], r["status"], r["message"]) for r in S.snap(points, nodes).collect()}
    assert got[1] == (0, "ok", None)
    assert got[2][:2] == (None, "error") and "within 200 m" in got[2][2]


def test_pairs_are_met_once(spark):
    r = [(i, (i * 37 % 100) / 10, (i * 61 % 100) / 10) for i in range(80)]
    points = spark.createDataFrame(r, "node_id bigint, x double, y double")
    got = sorted((x["ni"], x["nj"]) for x in S.distance_pairs(points, 1.5).collect())
    want = sorted((a[0], b[0]) for a in r for b in r if a[0] < b[0] and ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5 <= 1.5)
    assert got == want


def test_segments_near_zones_are_met_once(spark):
    import random

    rnd = random.Random(5)
    segs = [(i, 1000 + i, rnd.uniform(0, 3000), rnd.uniform(0, 3000)) for i in range(60)]
    segs = [(s, d, x, y, x + rnd.uniform(-900, 900), y + rnd.choice([0.0, rnd.uniform(-900, 900)])) for s, d, x, y in segs]
    zones = [(i, rnd.uniform(0, 3000), rnd.uniform(0, 3000), rnd.choice([1.0, 40.0, 300.0, 1500.0])) for i in range(40)]

    def dist(px, py, ax, ay, bx, by):
        dx, dy = bx - ax, by - ay
        t = max(0.0, min(1.0, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
        return ((px - ax - t * dx) ** 2 + (py - ay - t * dy) ** 2) ** 0.5

    got = sorted((r["incident_id"], r["src"]) for r in S.segments_within(
        spark.createDataFrame(zones, "incident_id bigint, x double, y double, radius_m double"),
        spark.createDataFrame(segs, "src bigint, dst bigint, ax double, ay double, bx double, by double")).collect())
    assert got == sorted((z[0], s[0]) for z in zones for s in segs if dist(z[1], z[2], *s[2:]) <= z[3])


def test_zones_are_not_broadcast_and_repeated_ids_are_counted_once_each(spark):
    nodes, _ = line(spark, 4)
    nodes = nodes.unionByName(spark.createDataFrame([(3, 250050.0, 2540000.0)], nodes.schema))
    zones = spark.createDataFrame([(1, 250000.0, 2540000.0, 160.0), (2, 250300.0, 2540000.0, 20.0)], "incident_id bigint, x double, y double, radius_m double")
    segs = S.edge_endpoints(spark.createDataFrame([(0, 1), (1, 2)], "src bigint, dst bigint"), nodes)
    for met in (S.within_radius(zones, nodes), S.segments_within(zones, segs)):
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [cls" in plan
    assert {r["incident_id"]: r["nodes_in_zone"] for r in S.nodes_in_zone(zones, nodes).collect()} == {1: 3, 2: 1}
    assert {(r["incident_id"], r["src"]) for r in S.segments_within(zones, segs).collect()} == {(1, 0), (1, 1)}


def test_paths_double_their_way_back(spark):
    nodes, edges = line(spark, 14)
    od = spark.createDataFrame([(1, 0, 13), (2, 5, 6), (3, 9, 9)], "query_id bigint, src bigint, dst bigint")
    _, paths = RT.shortest_paths(od.where("src <> dst"), nodes, edges, "length_m")
    got = {q: [r["node_id"] for r in sorted((x for x in paths.collect() if x["query_id"] == q), key=lambda x: x["seq"])] for q in (1, 2)}
    assert got == {1: list(range(14)), 2: [5, 6]}


def test_requests_become_answers(spark):
    nodes, edges = line(spark, 8)
    lon, lat = utm_to_wgs84(F.col("x"), F.col("y"))
    at = {r["node_id"]: (r["lat"], r["lon"]) for r in nodes.select("node_id", lat.alias("lat"), lon.alias("lon")).collect()}
    ask = [
        (1, *at[0], *at[5], None, None), (2, *at[3], *at[3], 50.0, "length_m"), (3, at[0][0] + 1, at[0][1], *at[5], 100.0, None),
        (4, None, at[0][1], *at[5], None, None), (5, *at[0], *at[5], None, "wishes"), (6, *at[0], *at[5], None, "length_m"),
    ]
    schema = "query_id bigint, start_lat double, start_lon double, end_lat double, end_lon double, max_snap_dist_m double, weight_type string"
    got = {r["query_id"]: r for r in answer_routes(spark.createDataFrame(ask, schema), nodes, edges).collect()}
    assert {q: r["status"] for q, r in got.items()} == {1: "success", 2: "warning", 3: "error", 4: "error", 5: "error", 6: "success"}
    assert got[1]["distance_km"] == 0.5 and len(got[1]["route_coords"]) == 6 and got[1]["cost"] == 50.0 and got[6]["cost"] == 500.0
    assert abs(got[1]["route_coords"][0][1] - at[0][0]) < 1e-7 and abs(got[1]["route_coords"][-1][0] - at[5][1]) < 1e-7
    assert "within 100 m" in got[3]["message"] and got[4]["message"] == "missing start_lat" and "wishes" in got[5]["message"]
    assert got[2]["avg_congestion_multiplier"] == 1.0 and len(got[2]["route_coords"]) == 1
    sim = spark.createDataFrame([(1, *at[4], *at[0], *at[7], 120.0, 500.0), (2, None, 72.0, *at[0], *at[7], None, None)],
                                "query_id bigint, lat double, lon double, start_lat double, start_lon double, end_lat double, end_lon double, radius_m double, max_snap_dist_m double")
    out = {r["query_id"]: r for r in simulate(sim, nodes, edges).collect()}
    assert out[1]["status"] == "success" and out[1]["edges_removed"] == 4 and out[1]["safe_status"] == "isolated" and out[1]["normal_distance_km"] == 0.7
    assert len(out[1]["normal_route_coords"]) == 8 and out[2]["status"] == "error" and out[2]["message"] == "missing lat"


def test_parallel_edge_of_key_zero(spark):
    nodes, edges = line(spark, 3)
    twin = edges.unionByName(spark.createDataFrame([(0, 1, 40.0, 1.0, 1.0, 1)], edges.schema))
    od = spark.createDataFrame([(1, 0, 2)], "query_id bigint, src bigint, dst bigint")
    _, paths = RT.shortest_paths(od, nodes, twin, "travel_time")
    assert RT.route_metrics(paths, twin).first()["distance_km"] == 0.14
    assert RT.route_metrics(paths, twin, parallel="first").first()["distance_km"] == 0.2


def test_round_tables_are_removed(spark):
    folder = spark.sparkContext.getCheckpointDir() or ""
    assert folder
    local = folder.removeprefix("file:")
    rounds, df = Rounds(), spark.range(3)
    before = set(os.listdir(local))
    for _ in range(6):
        (df,) = rounds.cut(df.select((F.col("id") + 1).alias("id")))
    assert len(set(os.listdir(local)) - before) == 2 and df.agg(F.min("id")).first()[0] == 6
    before = set(os.listdir(local))
    with Scratch() as scratch:
        assert scratch.cut(df).count() == 3 and len(set(os.listdir(local)) - before) == 1
    assert set(os.listdir(local)) == before


def test_streamed_incidents_equal_the_batch_on_the_streets(spark):
    from checks import load_all
    from checks.fixtures import fx
    from netresil.plans.impact import impact
    streamed = load_all().QUERIES["str01_stream_impact"](spark, SF)
    batch = impact(fx(spark, SF, "fx_incidents"), fx(spark, SF, "fx_nodes"), fx(spark, SF, "fx_edges"))
    assert sorted(map(tuple, streamed.select(*batch.columns).collect())) == sorted(map(tuple, batch.collect()))
