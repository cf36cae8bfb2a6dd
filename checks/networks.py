"""From masks to healed, weighted, ranked networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import fx
from checks.graphs import IMPACT, nodes
from checks.rasters import full_mask, grid, pix, shape
from checks.registry import query
from netresil.operators import graph as GR
from netresil.operators import healing as HL
from netresil.operators import learning as L
from netresil.operators import raster as R
from netresil.operators import skeleton as SK
from netresil.operators.components import connected_components
from netresil.plans import reconstruct as RC
from netresil.session import cut_lineage

PIXEL_M = 10.0


def skel(spark, sf):
    return cut_lineage(fx(spark, sf, "fx_skel"))


def road(spark, sf):
    return fx(spark, sf, "fx_mask").where(F.col("mask") == 1).select("r", "c")


@query("rst14_thin")
def _(spark, sf):
    return SK.thin(road(spark, sf))


@query("grf03_trace_edges")
def _(spark, sf):
    _, e = SK.trace_edges(skel(spark, sf), shape(spark, sf)[1], PIXEL_M)
    return e.drop("chain")


@query("grf03b_pixel_path")
def _(spark, sf):
    s = skel(spark, sf)
    n, _ = SK.trace_edges(s, shape(spark, sf)[1], PIXEL_M)
    return SK.pixel_paths(n.select(F.col("node_id").alias("id"), "r", "c"), s).select("id", F.to_json("pixel_path").alias("pixel_path"))


@query("win01_number_nodes", """
select r, c, r * (select max(c) + 1 from fx_pix) + c as node_id, row_number() over (order by r, c) - 1 as position from fx_skel""")
def _(spark, sf):
    from netresil.operators.routing import positions
    w = shape(spark, sf)[1]
    s = skel(spark, sf).withColumn("node_id", F.col("r") * w + F.col("c"))
    return s.join(positions(s), "node_id").select("r", "c", "node_id", F.col("pos").alias("position"))


def traced(spark, sf):
    s = skel(spark, sf)
    g = grid(spark, sf, PIXEL_M)
    n, e = SK.trace_edges(s, g.width, PIXEL_M)
    n = cut_lineage(n.withColumns({"x": g.x(F.col("r"), F.col("c")), "y": g.y(F.col("r"), F.col("c"))}))
    return s, n, cut_lineage(e)


@query("grf04_stub_vectors")
def _(spark, sf):
    s, n, e = traced(spark, sf)
    dead = n.join(GR.terminals(e), "node_id", "left_semi").select(F.col("node_id").alias("id"), "r", "c")
    return SK.stub_vectors(dead, s)


@query("grf05_heal_optical")
def _(spark, sf):
    _, n, e = traced(spark, sf)
    return HL.heal_optical(n, e, pix(spark, sf, "prob"), 100.0, 0.35, 0.05)


@query("grf06_heal_wcs_two_passes")
def _(spark, sf):
    return RC.heal_by_radar(full_mask(spark, sf), pix(spark, sf, "vv"), pix(spark, sf, "vh"), grid(spark, sf, PIXEL_M))["bridges"]


@query("grf07_max_spanning_bridges")
def _(spark, sf):
    n, t = nodes(spark, sf), cut_lineage(fx(spark, sf, "fx_trails"))
    c = fx(spark, sf, "fx_edges").select(F.col("src").alias("ni"), F.col("dst").alias("nj"), (1000.0 / F.col("length_m")).alias("score"))
    return HL.max_spanning_bridges(c, connected_components(n, t))


@query("grf10_betweenness")
def _(spark, sf):
    from netresil.operators.centrality import betweenness
    _, n, e = traced(spark, sf)
    return betweenness(n, SK.simple_graph(e), 300)


@query("grf11_composite_criticality")
def _(spark, sf):
    from netresil.operators.centrality import betweenness
    _, n, e = traced(spark, sf)
    simple = SK.simple_graph(e)
    scored = GR.composite_criticality(betweenness(n, simple, 300), GR.backbone(GR.core_number(n, simple)))
    return GR.edge_criticality(simple, scored)


@query("grf20_bounded_reach")
def _(spark, sf):
    s, n, e = traced(spark, sf)
    return SK.bounded_reach(gap_pairs(s, n, e), s)


def gap_pairs(s, n, e):
    from netresil.operators.spatial import distance_pairs
    dead = n.join(GR.terminals(e), "node_id", "left_semi")
    p = distance_pairs(dead.select("node_id", F.col("r").cast("double").alias("x"), F.col("c").cast("double").alias("y")), 10.0)
    big = lambda c: F.col(c).cast("bigint")
    return cut_lineage(p.select(
        F.concat_ws("-", "ni", "nj").alias("pair"), big("xi").alias("r1"), big("yi").alias("c1"), big("xj").alias("r2"), big("yj").alias("c2"),
        F.floor(F.col("gap") * 1.5).alias("limit")))


@query("rst18_corridor_coverage")
def _(spark, sf):
    s, n, e = traced(spark, sf)
    return SK.corridor_coverage(gap_pairs(s, n, e), road(spark, sf), shape(spark, sf))


@query("grf21_gap_labels")
def _(spark, sf):
    return RC.training_pairs(full_mask(spark, sf), pix(spark, sf, "vv"), pix(spark, sf, "vh"), grid(spark, sf, PIXEL_M)).select("ni", "nj", "outcome", "label")


@query("grf21b_gap_outcomes")
def _(spark, sf):
    p = RC.training_pairs(full_mask(spark, sf), pix(spark, sf, "vv"), pix(spark, sf, "vh"), grid(spark, sf, PIXEL_M))
    return L.label_stats(p)


HALF = "(2 * i * ({b} - {a}) + n - ((2 * i * ({b} - {a}) + n) % (2 * n) + 2 * n) % (2 * n)) // (2 * n)"


@query("grf22_fuse_population", f"""
, l as (select e.src, e.dst, e.edge_key, e.length_m, a.r as r1, a.c as c1, b.r as r2, b.c as c2 from fx_multi e join fx_nodes a on a.node_id = e.src join fx_nodes b on b.node_id = e.dst),
k as (select *, greatest(abs(r2 - r1), abs(c2 - c1)) as n from l), s as (select *, unnest(range(0, n + 1)) as i from k),
px as (select src, dst, edge_key, length_m, cast(r1 + {HALF.format(a='r1', b='r2')} as bigint) as r, cast(c1 + {HALF.format(a='c1', b='c2')} as bigint) as c from s),
d as (select src, dst, edge_key, length_m, coalesce(avg(case when p.pop < 0 then 0 else p.pop end), 0) as dens from px left join fx_pix p using (r, c) group by src, dst, edge_key, length_m),
q as (select quantile_cont(pop, 0.95) as top from fx_pix where pop > 0)
select src, dst, edge_key, round(dens, 6) as pop_density, round(1 + 4 * least(greatest(dens / top, 0e0), 1e0), 6) as congestion_level,
  round(length_m / 11.1e0 * (1 + 4 * least(greatest(dens / top, 0e0), 1e0)), 4) as travel_time from d, q""")
def _(spark, sf):
    from netresil.functions.expressions import clean_nodata
    from netresil.operators.population import fuse_population
    pop = pix(spark, sf, "pop").withColumn("value", clean_nodata(F.col("value")))
    out = fuse_population(fx(spark, sf, "fx_multi").select("src", "dst", "edge_key", "length_m"), fx(spark, sf, "fx_nodes"), pop)
    return out.select("src", "dst", "edge_key", F.round("pop_density", 6).alias("pop_density"), F.round("congestion_level", 6).alias("congestion_level"),
                      F.round("travel_time", 4).alias("travel_time"))


@query("grf18_demo_scenario")
def _(spark, sf):
    from netresil.plans.demo import demo_scenario
    return demo_scenario(nodes(spark, sf), cut_lineage(GR.normalize_edges(fx(spark, sf, "fx_trails"))))


def streamed(spark, sf, edges):
    """Every incident sent twice, in two files."""
    from checks.tables import scratch
    from netresil.streaming.incidents import impact_of_available
    path = scratch(spark, "stream")
    inc = fx(spark, sf, "fx_incidents").withColumn("at", F.timestamp_seconds(F.lit(1.7e9) + F.col("incident_id")))
    inc.unionByName(inc).repartition(2).write.parquet(f"{path}/in")
    impact_of_available(spark, f"{path}/in", f"{path}/out", f"{path}/state", nodes(spark, sf), cut_lineage(fx(spark, sf, edges)))
    return spark.read.parquet(f"{path}/out").drop("batch")


# on the streets the stream is compared with the batch answers, tests/test_rows_kept.py
@query("str01_stream_impact")
def _(spark, sf):
    return streamed(spark, sf, "fx_edges")


@query("str01b_stream_impact_trails", IMPACT, recursive=True)
def _(spark, sf):
    return streamed(spark, sf, "fx_trails")
