"""Components, cores, healing, routing, impact."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import fx, table
from checks.registry import query
from checks.scalar import INV, LADDER
from checks.spatial import HIT
from netresil.functions import expressions as X
from netresil.operators import components as C
from netresil.operators import graph as GR
from netresil.operators import routing as RT
from netresil.plans import impact as IM
from netresil.session import cut_lineage

# component label by propagation of the smallest id
CC = """, {name}_adj as (select src as a, dst as b from {edges} union all select dst, src from {edges}),
{name}(node_id, component) using key (node_id) as (
  select node_id, node_id from fx_nodes union
  select j.b, min(w.component) from {name} w join {name}_adj j on j.a = w.node_id join recurring.{name} o on o.node_id = j.b
  where w.component < o.component group by j.b)"""


def cc(edges, name="cc"):
    return CC.format(name=name, edges=edges)


SIZES = ", sizes as (select component, count(*) as nodes from cc group by component)"


def nodes(spark, sf):
    return cut_lineage(fx(spark, sf, "fx_nodes"))


def streets(spark, sf):
    return cut_lineage(GR.weigh_by_road_class(fx(spark, sf, "fx_multi")))


def trail_components(spark, sf):
    return C.connected_components(fx(spark, sf, "fx_nodes"), fx(spark, sf, "fx_trails"))


@query("grf01_connected_components", cc("fx_trails") + " select node_id, component from cc", recursive=True)
def _(spark, sf):
    return trail_components(spark, sf)


SUMMARY = """, s as (select cast(sum(nodes) as bigint) as nodes, count(*) as components, max(nodes) as largest from sizes),
e as (select count(*) as edges, sum(length_m) / 1e3 as km from {edges})
select nodes, edges, components, largest, round_even(km, 1) as total_km, round_even(largest * 1e2 / nodes, 2) as connectivity,
  round_even(largest * 1e2 / nodes, 1) as connectivity_report, round_even(largest * 1e0 / nodes, 3) as connectivity_ratio,
  round_even(1e0 - components * 1e0 / nodes, 3) as resilience, round_even(1e0 - components * 1e0 / nodes, 4) as resilience_summary,
  round_even(greatest(0, components - 1) / greatest(km, 0.001e0), 3) as break_density from s, e"""


def summary(spark, sf, edges):
    n, e = nodes(spark, sf), cut_lineage(fx(spark, sf, edges))
    return C.network_summary(n, e, C.connected_components(n, e))


@query("agg01_graph_summary", cc("fx_trails") + SIZES + SUMMARY.format(edges="fx_trails"), recursive=True)
def _(spark, sf):
    return summary(spark, sf, "fx_trails")


@query("agg02_connectivity_resilience", cc("fx_edges") + SIZES + SUMMARY.format(edges="fx_edges").replace(
    "select nodes, edges,", "select nodes,").replace("round_even(km, 1) as total_km, ", "").replace(
    ", round_even(greatest(0, components - 1) / greatest(km, 0.001e0), 3) as break_density", "")
    .replace("\n  round_even(greatest(0, components - 1) / greatest(km, 0.001e0), 3) as break_density", ""), recursive=True)
def _(spark, sf):
    return summary(spark, sf, "fx_edges").drop("edges", "total_km", "break_density")


@query("agg03_break_density", cc("fx_trails") + SIZES + """
select round(greatest(0, count(*) - 1) / greatest((select sum(length_m) / 1e3 from fx_trails), 0.001e0), 6) as break_density from sizes""", recursive=True)
def _(spark, sf):
    from netresil.operators.components import break_density
    n, e = nodes(spark, sf), cut_lineage(fx(spark, sf, "fx_trails"))
    return break_density(C.connected_components(n, e), e).select(F.round("density", 6).alias("break_density"))


@query("agg09_component_sizes", cc("fx_trails") + SIZES + " select component, nodes from sizes", recursive=True)
def _(spark, sf):
    return C.component_sizes(trail_components(spark, sf))


@query("agg20_quality_report", cc("fx_trails") + cc("fx_more", "cd").replace("fx_more", "more").replace(", cd_adj", ", more as (select src, dst from fx_trails union select src, dst from fx_edges), cd_adj") + """
, st as (select 'before' as stage, (select count(distinct component) from cc) as components, (select sum(length_m) from fx_trails) / 1e3 as km
  union all select 'after', (select count(distinct component) from cd), ((select sum(length_m) from fx_trails) + (select sum(length_m) from fx_edges)) / 1e3),
d as (select *, (components - 1) / greatest(km, 0.001e0) as density from st)
select stage, components, round(km, 4) as km, round(density, 6) as density,
  round(100 * ((select density from d where stage = 'before') - density) / greatest((select density from d where stage = 'before'), 1e-9), 6) as reduction_pct from d""", recursive=True)
def _(spark, sf):
    n, t = nodes(spark, sf), cut_lineage(fx(spark, sf, "fx_trails"))
    # written: components and length both read it
    more = cut_lineage(GR.add_edges(t, fx(spark, sf, "fx_edges"), "healed"))
    stages = None
    for stage, e in (("before", t), ("after", more)):
        one = C.break_density(C.connected_components(n, e), e).select(F.lit(stage).alias("stage"), "components", "km", "density")
        stages = one if stages is None else stages.unionByName(one)
    out = C.quality_report(stages)
    return out.select("stage", "components", F.round("km", 4).alias("km"), F.round("density", 6).alias("density"), F.round("reduction_pct", 6).alias("reduction_pct"))


PAIRS = """, pr as (select point_id, (point_id * 7919) % (select n from fx_dim) as src, case when point_id % 17 > 0 then (point_id * 6101 + 17) % (select n from fx_dim) end as dst from fx_points)"""


@query("jon14_same_component", PAIRS + cc("fx_trails") + """
select point_id, src, dst, coalesce(a.component = b.component, false) as same from pr left join cc a on a.node_id = src left join cc b on b.node_id = dst""", recursive=True)
def _(spark, sf):
    n = table(spark, sf, "orders").count()
    p = F.col("point_id")
    pr = fx(spark, sf, "fx_points").select(
        "point_id", ((p * 7919) % n).alias("src"), F.when(p % 17 > 0, (p * 6101 + 17) % n).alias("dst"))
    return C.same_component(pr, trail_components(spark, sf)).select("point_id", "src", "dst", "same")


LARGEST = SIZES + ", big as (select component from sizes order by nodes desc, component limit 1)"


@query("jon15_largest_component_nodes", cc("fx_trails") + LARGEST + " select node_id, component from cc where component in (select component from big)", recursive=True)
def _(spark, sf):
    return C.largest_component_nodes(trail_components(spark, sf)).select("node_id", "component")


@query("grf02_to_undirected", """
, d as (select src as u, dst as v, length_m, highway from fx_multi union all select dst, src, length_m, highway from fx_multi)
select least(u, v) as src, greatest(u, v) as dst, length_m, min(highway) as highway from d group by 1, 2, 3""")
def _(spark, sf):
    e = fx(spark, sf, "fx_multi").select("src", "dst", "length_m", "highway")
    return GR.to_undirected(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "length_m", "highway")))


@query("agg10_degree", """
select n as node_id, count(*) as degree from (select src as n from fx_multi union all select dst from fx_multi) t group by n""")
def _(spark, sf):
    return GR.degree(fx(spark, sf, "fx_multi"))


@query("agg24_distinct_edges", "select src, dst, edge_key, length_m, highway from fx_multi where edge_key = 0")
def _(spark, sf):
    return GR.distinct_edges(fx(spark, sf, "fx_multi"), ["edge_key"])


@query("win03_pick_parallel_edge", """
, k as (select src, dst, edge_key + case when highway is null then 1 else 0 end as edge_key, length_m from fx_multi)
select src, dst, arg_min(length_m, edge_key) as length_m, cast(min(edge_key) as int) as edge_key from k group by src, dst""")
def _(spark, sf):
    # pairs on unclassified streets have no key 0
    e = fx(spark, sf, "fx_multi").withColumn("edge_key", F.col("edge_key") + F.when(F.col("highway").isNull(), 1).otherwise(0))
    return GR.keyed_edges(e.select("src", "dst", "edge_key", "length_m"))


@query("win12_first_neighbour", """
select a as node_id, min(b) as neighbour from (select src as a, dst as b from fx_trails union all select dst, src from fx_trails) t group by a""")
def _(spark, sf):
    return GR.first_neighbour(fx(spark, sf, "fx_trails"))


@query("set01_add_edges", """
select src, dst, length_m, 'original' as edge_type, cast(null as varchar) as highway from fx_trails union all select src, dst, length_m, 'healed', highway from fx_edges""")
def _(spark, sf):
    return GR.add_edges(fx(spark, sf, "fx_trails"), fx(spark, sf, "fx_edges").select("src", "dst", "length_m", "highway"), "healed")


@query("set02_subtract_edges", "select src, dst from fx_edges except all select src, dst from fx_trails")
def _(spark, sf):
    return fx(spark, sf, "fx_edges").select("src", "dst").exceptAll(fx(spark, sf, "fx_trails").select("src", "dst"))


@query("grf23_edge_length_total", "select round(sum(length_m) / 1e3, 4) as km, count(*) as edges from fx_multi")
def _(spark, sf):
    return fx(spark, sf, "fx_multi").agg(F.round(F.sum("length_m") / 1000.0, 4).alias("km"), F.count("*").alias("edges"))


@query("grf08_core_number", None)
def _(spark, sf):
    return GR.core_number(nodes(spark, sf), fx(spark, sf, "fx_edges"))


@query("grf09_backbone", None)
def _(spark, sf):
    return GR.backbone(GR.core_number(nodes(spark, sf), fx(spark, sf, "fx_edges")))


# ---- routing -----------------------------------------------------------------

ADJ = """, ad as (select src as a, dst as b, min({w}) as w from ({edges}) q group by 1, 2),
adj as (select a, b, w from ad union all select b, a, w from ad)"""
STREETS = f"select src, dst, length_m, length_m / 11.1e0 * ({LADDER}) as travel_time from fx_multi"
# relaxations, cut off by the best cost so far of the query's own target
SEARCH = """, q as (select od_id, src, dst, x as tx, y as ty from fx_od join fx_nodes on node_id = dst where src <> dst),
best(od_id, node, dist) using key (od_id, node) as (
  select od_id, src, 0e0 from q union
  select w.od_id, j.b, min(w.dist + j.w) from best w join adj j on j.a = w.node join q on q.od_id = w.od_id join fx_nodes n on n.node_id = j.b
    left join recurring.best o on o.od_id = w.od_id and o.node = j.b left join recurring.best g on g.od_id = w.od_id and g.node = q.dst
  where w.dist + j.w < coalesce(o.dist, 1e18) and w.dist + j.w + {rate} * sqrt((n.x - q.tx) * (n.x - q.tx) + (n.y - q.ty) * (n.y - q.ty)) <= coalesce(g.dist, 1e18) + 1e-6
  group by w.od_id, j.b)"""


def od(spark, sf):
    return cut_lineage(fx(spark, sf, "fx_od").select(F.col("od_id").alias("query_id"), "src", "dst"))


@query("grf12_shortest_paths", ADJ.format(w="length_m", edges=STREETS) + SEARCH.format(rate="1e0") + """
select q.od_id as query_id, round(b.dist, 4) as cost from q join best b on b.od_id = q.od_id and b.node = q.dst""", recursive=True)
def _(spark, sf):
    q = od(spark, sf)
    costs, _ = RT.shortest_paths(q.where("src <> dst"), nodes(spark, sf), streets(spark, sf), "length_m")
    return costs.withColumn("cost", F.round("cost", 4))


@query("grf12b_shortest_paths_time", ADJ.format(w="travel_time", edges=STREETS) + SEARCH.format(rate="0.09e0") + """
select q.od_id as query_id, round(b.dist, 4) as cost from q join best b on b.od_id = q.od_id and b.node = q.dst""", recursive=True)
def _(spark, sf):
    q = od(spark, sf)
    costs, _ = RT.shortest_paths(q.where("src <> dst"), nodes(spark, sf), streets(spark, sf), "travel_time")
    return costs.withColumn("cost", F.round("cost", 4))


@query("grf13_route", INV + ADJ.format(w="length_m", edges=STREETS) + SEARCH.format(rate="1e0") + """
select o.od_id as query_id, o.src, o.dst, case when o.src = o.dst then 'warning' when b.dist is null then 'error' else 'success' end as status,
  round(case when o.src = o.dst then 0 else b.dist end, 4) as cost, round_even(case when o.src = o.dst then 0 else b.dist / 1e3 end, 2) as distance_km,
  case when b.dist is not null or o.src = o.dst then round(s.lon, 6) end as from_lon, case when b.dist is not null or o.src = o.dst then round(s.lat, 6) end as from_lat,
  case when b.dist is not null or o.src = o.dst then round(e.lon, 6) end as to_lon, case when b.dist is not null or o.src = o.dst then round(e.lat, 6) end as to_lat
from fx_od o left join best b on b.od_id = o.od_id and b.node = o.dst left join ll s on s.id = o.src left join ll e on e.id = o.dst""", recursive=True)
def _(spark, sf):
    from netresil.plans.requests import answer_routes, place
    n = nodes(spark, sf)
    at = place(n)
    end = lambda c, tag: at.select(F.col("node_id").alias(c), F.col("lat").alias(f"{tag}_lat"), F.col("lon").alias(f"{tag}_lon"))
    asked = od(spark, sf).join(end("src", "start"), "src").join(end("dst", "end"), "dst").select(
        "query_id", "start_lat", "start_lon", "end_lat", "end_lon", F.lit("length_m").alias("weight_type"))
    out = answer_routes(asked, n, streets(spark, sf))
    c = lambda i, j: F.round(F.get(F.element_at("route_coords", i), F.lit(j)), 6)
    return out.select("query_id", "src", "dst", "status", F.round("cost", 4).alias("cost"), "distance_km",
                      c(1, 0).alias("from_lon"), c(1, 1).alias("from_lat"), c(-1, 0).alias("to_lon"), c(-1, 1).alias("to_lat"))


@query("agg08_route_metrics", None)
def _(spark, sf):
    n, e = nodes(spark, sf), streets(spark, sf)
    _, paths = RT.shortest_paths(od(spark, sf).where("src <> dst"), n, e, "travel_time")
    return RT.route_metrics(paths, e)


@query("win02_path_segments", """
, s as (select l_orderkey, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as seq from lineitem)
select a.l_orderkey as query_id, cast(a.seq as int) as seq, a.l_partkey as u, b.l_partkey as v from s a join s b on b.l_orderkey = a.l_orderkey and b.seq = a.seq + 1""")
def _(spark, sf):
    from pyspark.sql import Window
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    p = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), (F.row_number().over(w) - 1).alias("seq"), F.col("l_partkey").alias("node_id"))
    return RT.path_segments(p)


@query("grf19_test_waypoints", cc("fx_trails") + LARGEST + """
, m as (select node_id, row_number() over (order by node_id) - 1 as pos, count(*) over () as n from cc where component in (select component from big))
select node_id, pos from m where pos = 0 or pos = n // 2""", recursive=True)
def _(spark, sf):
    return RT.demo_waypoints(C.largest_component_nodes(trail_components(spark, sf)))


@query("grf14_nearest_outside", """
, z as (select incident_id, x as zx, y as zy, radius_m as zr, (incident_id * 6151) % (select n from fx_dim) as src from fx_incidents),
adj as (select src as a, dst as b from fx_edges union select dst, src from fx_edges),
walk(hops, incident_id, node, hit) as (
  select 0, incident_id, src, sqrt((x - zx) * (x - zx) + (y - zy) * (y - zy)) > 3 * zr from z join fx_nodes on node_id = src
  union
  select distinct w.hops + 1, w.incident_id, j.b, sqrt((x - zx) * (x - zx) + (y - zy) * (y - zy)) > 3 * zr
  from walk w join adj j on j.a = w.node join z on z.incident_id = w.incident_id join fx_nodes on node_id = j.b
  where not w.hit and w.hops < 60),
f as (select incident_id, min(hops) as hops from walk where hit group by incident_id)
select w.incident_id as query_id, min(w.node) as node_id, cast(min(w.hops) as int) as hops from walk w join f on f.incident_id = w.incident_id and f.hops = w.hops
where w.hit group by w.incident_id""", recursive=True)
def _(spark, sf):
    n = table(spark, sf, "orders").count()
    z = fx(spark, sf, "fx_incidents").select(
        F.col("incident_id").alias("query_id"), ((F.col("incident_id") * 6151) % n).alias("src"),
        F.col("x").alias("zx"), F.col("y").alias("zy"), F.col("radius_m").alias("zr"))
    return RT.nearest_outside(z, nodes(spark, sf), fx(spark, sf, "fx_edges"))


# ---- impact ------------------------------------------------------------------

@query("grf15_failure_impact")
def _(spark, sf):
    from checks.rasters import grid, pix
    from netresil.operators.population import population_in_zone
    inc = cut_lineage(fx(spark, sf, "fx_incidents"))
    people = population_in_zone(inc, pix(spark, sf, "pop"), grid(spark, sf))
    return IM.impact(inc, nodes(spark, sf), fx(spark, sf, "fx_edges"), people)


@query("grf15b_failed_segments", HIT + f"""
, a as (select src, dst, {LADDER} as cong from fx_multi where edge_key = 0),
h as (select incident_id, hit.src, hit.dst, hit.length_m, least(0.99e0, hit.length_m / 500 * 0.4e0 + cong / 2 * 0.6e0) as raw from hit join a on a.src = hit.src and a.dst = hit.dst)
select incident_id, 'SEG-' || src || '-' || dst as id, length_m,
  case when round_even(raw, 3) > 0.75e0 then 'CRITICAL' when round_even(raw, 3) > 0.5e0 then 'HIGH' else 'MEDIUM' end as criticality from h""")
def _(spark, sf):
    e = fx(spark, sf, "fx_multi").withColumn("congestion_level", X.road_class_congestion(F.col("highway")))
    return IM.failed_segments(fx(spark, sf, "fx_incidents"), nodes(spark, sf), e).select("incident_id", "id", "length_m", "criticality")


def requests(spark, sf):
    i = fx(spark, sf, "fx_incidents")
    off = F.col("radius_m") + 150
    return i.select(
        F.col("incident_id").alias("query_id"), "x", "y", "radius_m", F.col("x").alias("sx"), (F.col("y") + off).alias("sy"),
        (F.col("x") + 60).alias("ex"), (F.col("y") - off).alias("ey"))


NEAR = """, ask as (select incident_id as query_id, x, y, radius_m, x as sx, y + radius_m + 150 as sy, x + 60 as ex, y - radius_m - 150 as ey from fx_incidents),
near_s as (select query_id, node_id, row_number() over (partition by query_id order by sqrt((n.x - sx) * (n.x - sx) + (n.y - sy) * (n.y - sy)), node_id) as k from ask
  join fx_nodes n on n.x between sx - 500 and sx + 500 and n.y between sy - 500 and sy + 500 and sqrt((n.x - sx) * (n.x - sx) + (n.y - sy) * (n.y - sy)) <= 500),
near_e as (select query_id, node_id, row_number() over (partition by query_id order by sqrt((n.x - ex) * (n.x - ex) + (n.y - ey) * (n.y - ey)), node_id) as k from ask
  join fx_nodes n on n.x between ex - 500 and ex + 500 and n.y between ey - 500 and ey + 500 and sqrt((n.x - ex) * (n.x - ex) + (n.y - ey) * (n.y - ey)) <= 500),
q as (select a.query_id, a.x as zx, a.y as zy, radius_m as zr, s.node_id as src, e.node_id as dst, t.x as tx, t.y as ty from ask a left join near_s s on s.query_id = a.query_id and s.k = 1
  left join near_e e on e.query_id = a.query_id and e.k = 1 left join fx_nodes t on t.node_id = e.node_id),
normal(query_id, node, dist) using key (query_id, node) as (
  select query_id, src, 0e0 from q where src is not null and dst is not null union
  select w.query_id, j.b, min(w.dist + j.w) from normal w join adj j on j.a = w.node join q on q.query_id = w.query_id join fx_nodes n on n.node_id = j.b
    left join recurring.normal o on o.query_id = w.query_id and o.node = j.b left join recurring.normal g on g.query_id = w.query_id and g.node = q.dst
  where w.dist + j.w < coalesce(o.dist, 1e18) and w.dist + j.w + 0.09e0 * sqrt((n.x - q.tx) * (n.x - q.tx) + (n.y - q.ty) * (n.y - q.ty)) <= coalesce(g.dist, 1e18) + 1e-6
  group by w.query_id, j.b)"""


@query("grf16_normal_route", ADJ.format(w="travel_time", edges=STREETS) + NEAR + """
select q.query_id, q.src, q.dst, case when q.src is null or q.dst is null then 'error' when b.dist is null then 'no_path' else 'success' end as normal_status,
  round(b.dist, 4) as normal_cost from q left join normal b on b.query_id = q.query_id and b.node = q.dst""", recursive=True)
def _(spark, sf):
    out = IM.compare_routes(requests(spark, sf), nodes(spark, sf), streets(spark, sf), 500.0)
    return out.select("query_id", "src", "dst", "normal_status", F.round("normal_cost", 4).alias("normal_cost"))


# routes that keep out of the zone, first between the ends themselves (searched from the destination, which may be walled in), then between their nearest nodes well outside
AVOID = """{name}(query_id, node, dist) using key (query_id, node) as (
  select query_id, src, 0e0 from {of} where src is not null and dst is not null union
  select w.query_id, j.b, min(w.dist + j.w) from {name} w join adj j on j.a = w.node join {of} q on q.query_id = w.query_id join fx_nodes n on n.node_id = j.b
    left join hit h on h.incident_id = w.query_id and h.src = least(w.node, j.b) and h.dst = greatest(w.node, j.b)
    left join recurring.{name} o on o.query_id = w.query_id and o.node = j.b left join recurring.{name} g on g.query_id = w.query_id and g.node = q.dst
  where h.src is null and w.dist + j.w < coalesce(o.dist, 1e18) and w.dist + j.w + 0.09e0 * sqrt((n.x - q.tx) * (n.x - q.tx) + (n.y - q.ty) * (n.y - q.ty)) <= coalesce(g.dist, 1e18) + 1e-6
  group by w.query_id, j.b)"""
COMPARE = HIT + ADJ.format(w="travel_time", edges=STREETS) + NEAR + """,
back as (select q.query_id, q.dst as src, q.src as dst, n.x as tx, n.y as ty from q left join fx_nodes n on n.node_id = q.src), """ + AVOID.format(name="direct", of="back") + """,
stuck as (select q.* from q left join direct d on d.query_id = q.query_id and d.node = q.src where q.src is not null and q.dst is not null and d.node is null),
ends as (select query_id, zx, zy, zr, 's' as tip, src as node from stuck union all select query_id, zx, zy, zr, 'e', dst from stuck),
links as (select src as a, dst as b from fx_edges union select dst, src from fx_edges),
walk(query_id, tip, node, hops, out_of) using key (query_id, tip, node) as (
  select query_id, tip, node, 0, sqrt((x - zx) * (x - zx) + (y - zy) * (y - zy)) > 3 * zr from ends join fx_nodes on node_id = node union
  select w.query_id, w.tip, l.b, min(w.hops + 1), bool_and(sqrt((n.x - e.zx) * (n.x - e.zx) + (n.y - e.zy) * (n.y - e.zy)) > 3 * e.zr)
  from walk w join links l on l.a = w.node join ends e on e.query_id = w.query_id and e.tip = w.tip join fx_nodes n on n.node_id = l.b
    left join recurring.walk o on o.query_id = w.query_id and o.tip = w.tip and o.node = l.b
  where not w.out_of and o.node is null group by w.query_id, w.tip, l.b),
firsts as (select query_id, tip, min(hops) as hops from walk where out_of group by 1, 2),
alts as (select w.query_id, w.tip, min(w.node) as node from walk w join firsts f on f.query_id = w.query_id and f.tip = w.tip and f.hops = w.hops where w.out_of group by 1, 2),
detours as (select s.query_id, a.node as src, b.node as dst, n.x as tx, n.y as ty from stuck s join alts a on a.query_id = s.query_id and a.tip = 's'
  join alts b on b.query_id = s.query_id and b.tip = 'e' join fx_nodes n on n.node_id = b.node where a.node <> b.node),
""" + AVOID.format(name="around", of="detours") + """,
res as (select q.query_id, q.src, q.dst, n.dist as normal_cost, coalesce(d.dist, r.dist) as safe_cost, d.dist is null and r.dist is not null as bypassed
  from q left join normal n on n.query_id = q.query_id and n.node = q.dst left join direct d on d.query_id = q.query_id and d.node = q.src
  left join detours on detours.query_id = q.query_id left join around r on r.query_id = q.query_id and r.node = detours.dst)
select query_id, src, dst, case when src is null or dst is null then 'error' when normal_cost is null then 'no_path' else 'success' end as normal_status,
  case when src is null or dst is null then 'error' when safe_cost is null then 'isolated' else 'success' end as safe_status,
  bypassed, round(normal_cost, 4) as normal_cost, round(safe_cost, 4) as safe_cost,
  round_even(round_even(safe_cost / 60, 1) - round_even(normal_cost / 60, 1), 1) as detour_mins from res"""


def compared(out):
    return out.select("query_id", "src", "dst", "normal_status", "safe_status", F.col("note").isNotNull().alias("bypassed"),
                      F.round("normal_cost", 4).alias("normal_cost"), F.round("safe_cost", 4).alias("safe_cost"), "detour_mins")


@query("grf16b_route_comparison", COMPARE, recursive=True)
def _(spark, sf):
    return compared(IM.compare_routes(requests(spark, sf), nodes(spark, sf), streets(spark, sf), 500.0))


# every trip ends inside its zone
INTO = COMPARE.replace("x + 60 as ex, y - radius_m - 150 as ey", "x as ex, y as ey")


@query("grf17_bypass_routes", INTO, recursive=True)
def _(spark, sf):
    q = requests(spark, sf).withColumns({"ex": F.col("x"), "ey": F.col("y")})
    return compared(IM.compare_routes(q, nodes(spark, sf), streets(spark, sf), 500.0))


# what failures do to the trails, which are a forest (every corner leads on to one other at most): a removed segment
# splits off the subtree behind it, less what segments removed further behind split off
IMPACT = cc("fx_trails") + SIZES + HIT.replace("from fx_edges e", "from (select src, dst, length_m, null as highway from fx_trails) e") + """,
touched as (select distinct h.incident_id, c.component from hit h join cc c on c.node_id = h.src),
uphill(node, a, d) as (select src, dst, 1 from fx_trails union all select u.node, t.dst, u.d + 1 from uphill u join fx_trails t on t.src = u.a),
subtree as (select n.node_id, 1 + count(u.node) as s from fx_nodes n left join uphill u on u.a = n.node_id group by 1),
above as (select h.incident_id, h.src, arg_min(u.a, u.d) as a from hit h join uphill u on u.node = h.src join hit g on g.incident_id = h.incident_id and g.src = u.a group by 1, 2),
cut as (select h.incident_id, h.src, c.component, s.s, v.a from hit h join subtree s on s.node_id = h.src join cc c on c.node_id = h.src
  left join above v on v.incident_id = h.incident_id and v.src = h.src),
pieces as (select c.incident_id, c.s - coalesce(sum(k.s), 0) as n from cut c left join cut k on k.incident_id = c.incident_id and k.a = c.src group by c.incident_id, c.src, c.s
  union all select c.incident_id, z.nodes - sum(c.s) from cut c join sizes z on z.component = c.component where c.a is null group by c.incident_id, c.component, z.nodes),
open as (select incident_id, count(*) as k, max(n) as big from pieces group by 1),
shut as (select i.incident_id, max(s.nodes) as big from fx_incidents i join sizes s on true left join touched t on t.incident_id = i.incident_id and t.component = s.component
  where t.component is null group by 1),
t as (select incident_id, count(*) as k from touched group by 1), rem as (select incident_id, count(*) as k from hit group by 1),
inside as (select p.incident_id, count(*) as k from fx_incidents p join fx_nodes n on n.x between p.x - p.radius_m and p.x + p.radius_m
  and n.y between p.y - p.radius_m and p.y + p.radius_m and sqrt((p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y)) <= p.radius_m group by 1),
b as (select (select count(*) from fx_nodes) * 1e0 as n, (select count(*) from sizes) as k, (select max(nodes) from sizes) as big),
f as (select i.incident_id, b.n, b.k as components_before, b.k - coalesce(t.k, 0) + coalesce(open.k, 0) as components_after, b.big as big_before,
    cast(greatest(coalesce(shut.big, 0), coalesce(open.big, 0)) as bigint) as big_after, coalesce(rem.k, 0) as edges_removed, coalesce(inside.k, 0) as nodes_in_zone,
    cast(floor(pi() * (i.radius_m / 1e3 * (i.radius_m / 1e3)) * {density} * {share}) as bigint) as population_affected
  from fx_incidents i join b on true left join t on t.incident_id = i.incident_id left join open on open.incident_id = i.incident_id
    left join shut on shut.incident_id = i.incident_id left join rem on rem.incident_id = i.incident_id left join inside on inside.incident_id = i.incident_id),
c as (select *, round_even(big_before / n * 100, 2) as connectivity_before, round_even(big_after / n * 100, 2) as connectivity_after from f),
p as (select *, round_even(least(1e0, edges_removed * 0.05e0 + (connectivity_before - connectivity_after) / 50e0), 2) as priority_score from c)
select incident_id, components_before, components_after, greatest(0, components_after - components_before) as disconnected_wards, population_affected,
  connectivity_before, connectivity_after, round_even(1e0 - components_before / n, 3) as resilience_before, round_even(1e0 - components_after / n, 3) as resilience_after,
  edges_removed, nodes_in_zone, priority_score,
  case when priority_score > 0.75e0 then 'CRITICAL' when priority_score > 0.45e0 then 'HIGH' else 'MEDIUM' end as emergency_priority from p""".format(
    density=f"{float(X.POPULATION_DENSITY_KM2)!r}::double", share=f"{float(X.POPULATION_SHARE)!r}::double")


@query("grf15c_failure_impact_trails", IMPACT, recursive=True)
def _(spark, sf):
    return IM.impact(fx(spark, sf, "fx_incidents"), nodes(spark, sf), fx(spark, sf, "fx_trails"))
