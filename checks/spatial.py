"""Spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import fx, table
from checks.registry import query
from checks.scalar import psd_sql
from netresil.operators import graph as GR
from netresil.operators import spatial as S
from netresil.operators.components import connected_components, largest_component_nodes

D2 = "(p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y)"


@query("jon01_edge_endpoints", """
select e.src, e.dst, e.edge_key, a.x as ax, a.y as ay, b.x as bx, b.y as by
from fx_multi e join fx_nodes a on a.node_id = e.src join fx_nodes b on b.node_id = e.dst""")
def _(spark, sf):
    return S.edge_endpoints(fx(spark, sf, "fx_multi").select("src", "dst", "edge_key"), fx(spark, sf, "fx_nodes"))


@query("jon02_snap", f"""
, d as (select p.point_id, n.node_id, sqrt({D2}) as dist from fx_points p join fx_nodes n
  on n.x between p.x - 500 and p.x + 500 and n.y between p.y - 500 and p.y + 500),
b as (select point_id, node_id, dist, row_number() over (partition by point_id order by dist, node_id) as k from d where dist <= 500)
select p.point_id, b.node_id, round(b.dist, 6) as dist, case when b.node_id is null then 'error' else 'ok' end as status
from fx_points p left join b on b.point_id = p.point_id and b.k = 1""")
def _(spark, sf):
    return S.snap(fx(spark, sf, "fx_points"), fx(spark, sf, "fx_nodes"), 500.0).withColumn("dist", F.round("dist", 6)).drop("message")


@query("jon03_knn", f"""
, d as (select p.point_id, n.node_id, sqrt({D2}) as dist from fx_points p join fx_nodes n on true),
b as (select point_id, node_id, dist, row_number() over (partition by point_id order by dist, node_id) as k from d)
select point_id, node_id, round(dist, 6) as dist, cast(k as int) as rank from b where k <= 5""")
def _(spark, sf):
    return S.nearest_nodes(fx(spark, sf, "fx_points"), fx(spark, sf, "fx_nodes"), 5).withColumn("dist", F.round("dist", 6))


@query("jon04_within_radius", f"""
select p.incident_id, n.node_id, round(sqrt({D2}), 6) as dist from fx_incidents p join fx_nodes n
on n.x between p.x - p.radius_m and p.x + p.radius_m and n.y between p.y - p.radius_m and p.y + p.radius_m and sqrt({D2}) <= p.radius_m""")
def _(spark, sf):
    return S.within_radius(fx(spark, sf, "fx_incidents"), fx(spark, sf, "fx_nodes")).withColumn("dist", F.round("dist", 6))


HIT = f"""
, g as (select e.src, e.dst, e.length_m, e.highway, a.x as x1, a.y as y1, b.x as x2, b.y as y2 from fx_edges e join fx_nodes a on a.node_id = e.src join fx_nodes b on b.node_id = e.dst),
hit as (select i.incident_id, i.radius_m, g.* from fx_incidents i join g on least(x1, x2) <= i.x + i.radius_m and greatest(x1, x2) >= i.x - i.radius_m
  and least(y1, y2) <= i.y + i.radius_m and greatest(y1, y2) >= i.y - i.radius_m
  where {psd_sql('i.x', 'i.y').replace('a.x', 'x1').replace('a.y', 'y1').replace('b.x', 'x2').replace('b.y', 'y2')} <= i.radius_m)"""


@query("jon05_segments_within", HIT + " select incident_id, src, dst from hit")
def _(spark, sf):
    segs = S.edge_endpoints(fx(spark, sf, "fx_edges"), fx(spark, sf, "fx_nodes"))
    return S.segments_within(fx(spark, sf, "fx_incidents"), segs).select("incident_id", "src", "dst")


@query("jon06_distance_pairs", f"""
select p.node_id as ni, n.node_id as nj, round(sqrt({D2}), 6) as gap from fx_nodes p join fx_nodes n
on p.node_id < n.node_id and n.x between p.x - 180 and p.x + 180 and n.y between p.y - 180 and p.y + 180 and sqrt({D2}) <= 180""")
def _(spark, sf):
    return S.distance_pairs(fx(spark, sf, "fx_nodes"), 180.0).select("ni", "nj", F.round("gap", 6).alias("gap"))


@query("jon16_remove_edges", """
select src, dst, edge_key, length_m from fx_multi m where not exists (select 1 from fx_trails t
  where least(t.src, t.dst) = least(m.src, m.dst) and greatest(t.src, t.dst) = greatest(m.src, m.dst))""")
def _(spark, sf):
    return GR.remove_edges(fx(spark, sf, "fx_multi"), fx(spark, sf, "fx_trails")).select("src", "dst", "edge_key", "length_m")


@query("jon16b_remove_one_parallel", """
select src, dst, edge_key, length_m from fx_multi m where edge_key > 0 or not exists (select 1 from fx_trails t
  where least(t.src, t.dst) = least(m.src, m.dst) and greatest(t.src, t.dst) = greatest(m.src, m.dst))""")
def _(spark, sf):
    return GR.remove_one_parallel(fx(spark, sf, "fx_multi"), fx(spark, sf, "fx_trails")).select("src", "dst", "edge_key", "length_m")


@query("agg07_population_in_zone", """
, g as (select 250000 + c * 100 as x, 2540000 + r * 100 as y, pop from fx_pix where pop > 0),
z as (select i.incident_id, sum(pop) as s from fx_incidents i join g on g.x between i.x - i.radius_m and i.x + i.radius_m and g.y between i.y - i.radius_m and i.y + i.radius_m group by i.incident_id)
select i.incident_id, cast(floor(coalesce(z.s, 0)) as bigint) as population_affected from fx_incidents i left join z on z.incident_id = i.incident_id""")
def _(spark, sf):
    from checks.rasters import grid, pix
    from netresil.operators.population import population_in_zone
    return population_in_zone(fx(spark, sf, "fx_incidents"), pix(spark, sf, "pop"), grid(spark, sf))


@query("agg25_simulation_counts", HIT + f"""
, e as (select incident_id, count(*) as k from hit group by incident_id),
n as (select p.incident_id, count(*) as k from fx_incidents p join fx_nodes n on n.x between p.x - p.radius_m and p.x + p.radius_m
  and n.y between p.y - p.radius_m and p.y + p.radius_m and sqrt({D2}) <= p.radius_m group by p.incident_id)
select i.incident_id, coalesce(e.k, 0) as edges_removed, coalesce(n.k, 0) as nodes_in_zone
from fx_incidents i left join e on e.incident_id = i.incident_id left join n on n.incident_id = i.incident_id""")
def _(spark, sf):
    inc, n = fx(spark, sf, "fx_incidents"), fx(spark, sf, "fx_nodes")
    hit = S.segments_within(inc, S.edge_endpoints(fx(spark, sf, "fx_edges"), n)).groupBy("incident_id").agg(F.count("*").alias("k"))
    return S.nodes_in_zone(inc, n).join(hit, "incident_id", "left").select(
        "incident_id", F.coalesce("k", F.lit(0).cast("bigint")).alias("edges_removed"), "nodes_in_zone")


@query("srt03_nearest_to_place", f"""
, d as (select p.point_id, min(sqrt({D2})) as dist from fx_points p join fx_nodes n on true group by p.point_id)
select point_id, round(dist, 6) as dist, dist < 500 as covered from d""")
def _(spark, sf):
    return S.coverage(fx(spark, sf, "fx_points"), fx(spark, sf, "fx_nodes")).withColumn("dist", F.round("dist", 6))


@query("srt04_random_pick")
def _(spark, sf):
    n = fx(spark, sf, "fx_nodes")
    members = largest_component_nodes(connected_components(n, fx(spark, sf, "fx_trails"))).select("node_id")
    return S.random_near(fx(spark, sf, "fx_points"), n, members)
