"""Projections, scalar rules and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import fx, table
from checks.registry import query
from netresil.functions import expressions as X
from netresil.functions import geometry as G
from netresil.functions import projection as P
from netresil.operators import graph as GR

LADDER = """case when coalesce(highway, 'residential') like '%motorway%' then 1.2e0
  when coalesce(highway, 'residential') like '%trunk%' then 1.3e0
  when coalesce(highway, 'residential') like '%primary%' then 1.5e0
  when coalesce(highway, 'residential') like '%secondary%' then 1.8e0
  when coalesce(highway, 'residential') like '%tertiary%' then 2.0e0
  when coalesce(highway, 'residential') like '%residential%' then 2.5e0 else 2.0e0 end"""


@query("prj01_normalize_edges", """
select src, dst, edge_key, round(length_m, 4) as length_m, round(length_m / 11.1e0, 4) as travel_time, 1e0 as congestion_level
from fx_multi""")
def _(spark, sf):
    e = fx(spark, sf, "fx_multi").select("src", "dst", "edge_key", F.col("length_m").alias("length"), F.lit(5.0).alias("length_m"))
    return GR.normalize_edges(e).select(
        "src", "dst", "edge_key", F.round("length_m", 4).alias("length_m"),
        F.round("travel_time", 4).alias("travel_time"), "congestion_level")


@query("prj02_road_class_congestion", f"""
select highway, {LADDER} as congestion, count(*) as segments from fx_multi group by highway""")
def _(spark, sf):
    e = fx(spark, sf, "fx_multi").withColumn("highways", F.when(F.col("highway").isNotNull(), F.array("highway", F.lit("trunk"))))
    e = e.withColumn("highway", X.first_class(F.col("highways")))
    return e.groupBy("highway", X.road_class_congestion(F.col("highway")).alias("congestion")).agg(F.count("*").alias("segments"))


@query("prj03_travel_time", f"""
select src, dst, edge_key, round(length_m / 11.1e0 * ({LADDER}), 4) as travel_time from fx_multi""")
def _(spark, sf):
    return GR.weigh_by_road_class(fx(spark, sf, "fx_multi")).select("src", "dst", "edge_key", F.round("travel_time", 4).alias("travel_time"))


@query("prj04_congestion_band", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, score / 2 as congestion,
  case when score / 2 >= 3 then 'HIGH' when score / 2 >= 2 then 'MEDIUM' when score / 2 >= 1.3e0 then 'LOW' else 'VERY LOW' end as band
from (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 6 as score from lineitem) t""")
def _(spark, sf):
    c = F.col("l_quantity") / 6 / 2
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c.alias("congestion"), X.congestion_band(c).alias("band"))


@query("prj05_congestion_color", """
select color, count(*) as n from (select case when l_quantity / 10 < 2 then '#2ecc71' when l_quantity / 10 < 3.5e0 then '#f1c40f'
  else '#e74c3c' end as color from lineitem) t group by color""")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy(X.congestion_color(F.col("l_quantity") / 10).alias("color")).agg(F.count("*").alias("n"))


@query("prj06_criticality_style", """
select r, c, case when prob >= 0.7e0 then '#0F6E56' when prob >= 0.3e0 then '#BA7517' else '#9A9A9A' end as color,
  cast(case when prob >= 0.7e0 then 4 when prob >= 0.3e0 then 2 else 1 end as int) as width from fx_pix""")
def _(spark, sf):
    p = F.col("prob")
    return fx(spark, sf, "fx_pix").select("r", "c", X.criticality_color(p).alias("color"), X.criticality_width(p).alias("width"))


SEG = f"""select src, dst, edge_key, least(0.99e0, length_m / 500 * 0.4e0 + ({LADDER}) / 2 * 0.6e0) as raw from fx_multi"""


@query("prj07_segment_score", f"""
, s as ({SEG})
select src, dst, edge_key, round(raw, 6) as raw,
  case when round_even(raw, 3) > 0.75e0 then 'CRITICAL' when round_even(raw, 3) > 0.5e0 then 'HIGH' else 'MEDIUM' end as criticality from s""")
def _(spark, sf):
    e = fx(spark, sf, "fx_multi").withColumn("cong", X.road_class_congestion(F.col("highway")))
    raw = F.least(F.lit(0.99), X.segment_length(F.col("length_m")) / 500.0 * 0.4 + F.col("cong") / 2.0 * 0.6)
    return e.select("src", "dst", "edge_key", F.round(raw, 6).alias("raw"),
                    X.segment_criticality(X.segment_score(F.col("length_m"), F.col("cong"))).alias("criticality"))


@query("prj08_emergency_priority", """
, t as (select o_orderkey, least(1e0, (o_custkey % 19) * 0.05e0 + (o_totalprice - floor(o_totalprice)) * 4 / 50) as raw from orders)
select o_orderkey, round(raw, 6) as raw,
  case when round_even(raw, 2) > 0.75e0 then 'CRITICAL' when round_even(raw, 2) > 0.45e0 then 'HIGH' else 'MEDIUM' end as priority from t""")
def _(spark, sf):
    removed = F.col("o_custkey") % 19
    frac = (F.col("o_totalprice") - F.floor("o_totalprice")) * 4
    raw = F.least(F.lit(1.0), removed * 0.05 + frac / 50)
    return table(spark, sf, "orders").select(
        "o_orderkey", F.round(raw, 6).alias("raw"),
        X.emergency_priority(X.priority_score(removed, frac, F.lit(0.0))).alias("priority"))


@query("prj09_feature_ids", """
select src, dst, 'E-' || cast(src as varchar) || '-' || cast(dst as varchar) as feature_id,
  substring(replace('SEG-' || cast(src as varchar) || '-' || cast(dst as varchar), 'SEG-', 'SG-'), 1, 10) as short_id from fx_edges""")
def _(spark, sf):
    u, v = F.col("src"), F.col("dst")
    return fx(spark, sf, "fx_edges").select(
        "src", "dst", X.feature_id("E", u, v).alias("feature_id"), X.short_id(X.feature_id("SEG", u, v)).alias("short_id"))


@query("prj10_to_lonlat", """
select c_custkey, case when a > 40 then a else b end as lon, case when a > 40 then b else a end as lat
from (select c_custkey, case when c_nationkey % 2 = 0 then 72 + c_custkey % 97 / 1e2 else 23 + c_custkey % 89 / 1e2 end as a,
  case when c_nationkey % 2 = 0 then 23 + c_custkey % 89 / 1e2 else 72 + c_custkey % 97 / 1e2 end as b from customer) t""")
def _(spark, sf):
    lon, lat = 72 + F.col("c_custkey") % 97 / 100.0, 23 + F.col("c_custkey") % 89 / 100.0
    pair = F.when(F.col("c_nationkey") % 2 == 0, F.array(lon, lat)).otherwise(F.array(lat, lon))
    out = X.to_lonlat(pair)
    return table(spark, sf, "customer").select("c_custkey", out[0].alias("lon"), out[1].alias("lat"))


def _series(coeffs, fun, angle, hyp, other, scale="{k}"):
    return " + ".join(f"{a!r} * {fun}({2 * k} * {angle}) * {hyp}({2 * k} * {other})" for k, a in enumerate(coeffs, 1))


FWD = f"""
, g as (select c_custkey as id, 70 + (c_custkey * 7919) % 9000 / 1e3 as lon, 5 + (c_custkey * 104729) % 50000 / 1e3 as lat from customer),
a as (select *, radians(lon - 75e0) as lam, sin(radians(lat)) as s from g),
b as (select *, sinh(atanh(s) - {P.E!r} * atanh({P.E!r} * s)) as t from a),
d as (select *, atan2(t, cos(lam)) as xi, atanh(sin(lam) / sqrt(1 + t * t)) as eta from b),
u as (select id, lon, lat, {P.K0 * P.RADIUS!r} * (eta + {_series(P.ALPHA, 'cos', 'xi', 'sinh', 'eta')}) + 500000 as x,
  {P.K0 * P.RADIUS!r} * (xi + {_series(P.ALPHA, 'sin', 'xi', 'cosh', 'eta')}) as y from d)"""


def _lonlat(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), (70 + (F.col("c_custkey") * 7919) % 9000 / 1000.0).alias("lon"),
        (5 + (F.col("c_custkey") * 104729) % 50000 / 1000.0).alias("lat"))


@query("prj11_wgs84_to_utm", FWD + " select id, round(x, 4) as x, round(y, 4) as y from u")
def _(spark, sf):
    x, y = P.wgs84_to_utm(F.col("lon"), F.col("lat"))
    return _lonlat(spark, sf).select("id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


INV = f"""
, i0 as (select node_id as id, y / {P.K0 * P.RADIUS!r} as xi0, (x - 500000) / {P.K0 * P.RADIUS!r} as eta0 from fx_nodes),
i1 as (select id, xi0 - ({_series(P.BETA, 'sin', 'xi0', 'cosh', 'eta0')}) as xi, eta0 - ({_series(P.BETA, 'cos', 'xi0', 'sinh', 'eta0')}) as eta from i0),
i2 as (select *, asin(sin(xi) / cosh(eta)) as chi from i1),
ll as (select id, 75 + degrees(atan2(sinh(eta), cos(xi))) as lon,
  degrees(chi + {' + '.join(f'{d!r} * sin({2 * k} * chi)' for k, d in enumerate(P.DELTA, 1))}) as lat from i2)"""


@query("prj12_utm_to_wgs84", INV + " select id, round(lon, 8) as lon, round(lat, 8) as lat from ll")
def _(spark, sf):
    lon, lat = P.utm_to_wgs84(F.col("x"), F.col("y"))
    return fx(spark, sf, "fx_nodes").select(F.col("node_id").alias("id"), F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


@query("prj13_transform_bounds", """
, boxes as (select c_nationkey, min(70 + (c_custkey * 7919) % 9000 / 1e3) as min_x, min(5 + (c_custkey * 104729) % 50000 / 1e3) as min_y,
  max(70 + (c_custkey * 7919) % 9000 / 1e3) as max_x, max(5 + (c_custkey * 104729) % 50000 / 1e3) as max_y from customer group by c_nationkey),
ring as (select c_nationkey, i, case when i < 20 then min_x + (max_x - min_x) * ((i % 20) / 2e1) when i < 40 then max_x
    when i < 60 then max_x - (max_x - min_x) * ((i % 20) / 2e1) else min_x end as lon,
  case when i < 20 then min_y when i < 40 then min_y + (max_y - min_y) * ((i % 20) / 2e1)
    when i < 60 then max_y else max_y - (max_y - min_y) * ((i % 20) / 2e1) end as lat from boxes, range(80) t(i)),
""" + FWD[FWD.index("a as ("):].replace("from g)", "from (select c_nationkey as id, lon, lat from ring) q)") + """
select id, round(min(x), 4) as min_x, round(min(y), 4) as min_y, round(max(x), 4) as max_x, round(max(y), 4) as max_y from u group by id""")
def _(spark, sf):
    pts = _lonlat(spark, sf).join(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey"), "id")
    boxes = pts.groupBy(F.col("c_nationkey").alias("id")).agg(
        F.min("lon").alias("min_x"), F.min("lat").alias("min_y"), F.max("lon").alias("max_x"), F.max("lat").alias("max_y"))
    out = P.transform_bounds(boxes, True, ["id"])
    return out.select("id", *[F.round(c, 4).alias(c) for c in out.columns[1:]])


def _meta():
    return F.struct(
        F.lit(80.0).alias("a"), F.lit(0.25).alias("b"), F.lit(250000.0).alias("c"),
        F.lit(-0.5).alias("d"), F.lit(-80.0).alias("e"), F.lit(2550000.0).alias("f"))


@query("prj14_pixel_xy", """
select r, c, 250000 + 80 * (c + 0.5e0) + 0.25e0 * (r + 0.5e0) as x, 2550000 - 0.5e0 * (c + 0.5e0) - 80 * (r + 0.5e0) as y from fx_pix""")
def _(spark, sf):
    r, c = F.col("r"), F.col("c")
    return fx(spark, sf, "fx_pix").select("r", "c", X.pixel_x(_meta(), r, c).alias("x"), X.pixel_y(_meta(), r, c).alias("y"))


HAV = "6371000e0 * 2 * atan2(sqrt(h), sqrt(1 - h))"


@query("prj15_haversine", f"""
, g as (select c_custkey as id, 70 + (c_custkey * 7919) % 9000 / 1e3 as lon, 5 + (c_custkey * 104729) % 50000 / 1e3 as lat from customer),
t as (select id, pow(sin(radians(23.0225e0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(23.0225e0)) * pow(sin(radians(72.5714e0 - lon) / 2), 2) as h from g)
select id, round({HAV}, 4) as dist_m from t""")
def _(spark, sf):
    d = X.haversine_m(F.col("lon"), F.col("lat"), F.lit(72.5714), F.lit(23.0225))
    return _lonlat(spark, sf).select("id", F.round(d, 4).alias("dist_m"))


@query("prj16_pixel_size", f"""
, m as (select p_partkey as id, p_partkey % 2 = 0 as geographic, case when p_partkey % 2 = 0 then 0.0001e0 * p_size else 1e0 * p_size end as a,
    cast(100 + p_partkey % 50 as double) as height, cast(200 + p_partkey % 70 as double) as width from part),
n as (select *, 72 + a * (width / 2 + 0.5e0) as lon1, 72 + a * (width / 2 + 1.5e0) as lon2, 23 - a * (height / 2 + 0.5e0) as lat from m),
t as (select *, cos(radians(lat)) * cos(radians(lat)) * pow(sin(radians(lon2 - lon1) / 2), 2) as h from n)
select id, round(case when geographic then {HAV} else abs(a) end, 4) as size_m,
  round(case when a < 0.001e0 then a * 111000 else a end, 4) as rough_m from t""")
def _(spark, sf):
    geo = F.col("p_partkey") % 2 == 0
    a = F.when(geo, F.lit(0.0001) * F.col("p_size")).otherwise(F.col("p_size") * 1.0)
    m = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), geo.alias("geographic"),
        F.struct(a.alias("a"), F.lit(0.0).alias("b"), F.lit(72.0).alias("c"), F.lit(0.0).alias("d"), (-a).alias("e"), F.lit(23.0).alias("f")).alias("meta"),
        (100 + F.col("p_partkey") % 50).cast("double").alias("height"), (200 + F.col("p_partkey") % 70).cast("double").alias("width"))
    size = X.pixel_size_m(F.col("meta"), F.col("geographic"), F.col("height"), F.col("width"))
    return m.select("id", F.round(size, 4).alias("size_m"), F.round(X.pixel_size_rough(F.col("meta.a")), 4).alias("rough_m"))


@query("prj17_metres_to_degrees", """
select c_custkey as id, round((150 + ((c_custkey * 37) % 8) * 50) / (111320 * cos(radians(5 + (c_custkey * 104729) % 50000 / 1e3))), 8) as dlon,
  round((150 + ((c_custkey * 37) % 8) * 50) / 111320e0, 8) as dlat from customer""")
def _(spark, sf):
    r = (150 + ((F.col("id") * 37) % 8) * 50).cast("double")
    lon, lat = X.metres_to_degrees(r, F.col("lat"))
    return _lonlat(spark, sf).select("id", F.round(lon, 8).alias("dlon"), F.round(lat, 8).alias("dlat"))


PSD = """sqrt(({px} - (a.x + {t} * (b.x - a.x))) * ({px} - (a.x + {t} * (b.x - a.x))) + ({py} - (a.y + {t} * (b.y - a.y))) * ({py} - (a.y + {t} * (b.y - a.y))))"""
TAT = """greatest(0e0, least(1e0, (({px} - a.x) * (b.x - a.x) + ({py} - a.y) * (b.y - a.y)) / nullif((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y), 0)))"""


def psd_sql(px, py):
    return PSD.format(px=px, py=py, t=TAT.format(px=px, py=py))


@query("prj18_point_segment_distance", f"""
select e.src, e.dst, round({psd_sql('255000e0', '2545000e0')}, 4) as dist
from fx_edges e join fx_nodes a on a.node_id = e.src join fx_nodes b on b.node_id = e.dst""")
def _(spark, sf):
    from netresil.operators.spatial import edge_endpoints
    e = edge_endpoints(fx(spark, sf, "fx_edges"), fx(spark, sf, "fx_nodes"))
    d = G.point_segment_distance(F.lit(255000.0), F.lit(2545000.0), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return e.select("src", "dst", F.round(d, 4).alias("dist"))


@query("prj19_unit_vectors", """
, v as (select e.src, e.dst, b.x - a.x as dx, b.y - a.y as dy from fx_edges e join fx_nodes a on a.node_id = e.src join fx_nodes b on b.node_id = e.dst)
select src, dst, round(dx / (sqrt(dx * dx + dy * dy) + 1e-9), 8) as ux, round(dy / (sqrt(dx * dx + dy * dy) + 1e-9), 8) as uy,
  round((dx * 3 + dy * 4) / 5, 6) as along from v""")
def _(spark, sf):
    from netresil.operators.spatial import edge_endpoints
    e = edge_endpoints(fx(spark, sf, "fx_edges"), fx(spark, sf, "fx_nodes"))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    ux, uy = G.unit_vector(dx, dy)
    return e.select("src", "dst", F.round(ux, 8).alias("ux"), F.round(uy, 8).alias("uy"),
                    F.round(G.dot(dx, dy, F.lit(3.0), F.lit(4.0)) / 5, 6).alias("along"))


LINES = """select node_id as id, r as r1, c as c1, r + node_id % 11 - 5 as r2, c + node_id % 7 - 3 as c2 from fx_nodes"""
HALF = "(2 * i * ({b} - {a}) + n - ((2 * i * ({b} - {a}) + n) % (2 * n) + 2 * n) % (2 * n)) // (2 * n)"


@query("prj20_bresenham", f"""
, l as ({LINES}),
k as (select *, greatest(abs(r2 - r1), abs(c2 - c1)) as steps, greatest(abs(r2 - r1), abs(c2 - c1), 1) as n from l),
p as (select *, unnest(range(0, steps + 1)) as i from k)
select id, i, cast(r1 + {HALF.format(a='r1', b='r2')} as bigint) as r, cast(c1 + {HALF.format(a='c1', b='c2')} as bigint) as c from p""")
def _(spark, sf):
    n = fx(spark, sf, "fx_nodes").select(
        F.col("node_id").alias("id"), F.col("r").alias("r1"), F.col("c").alias("c1"),
        (F.col("r") + F.col("node_id") % 11 - 5).alias("r2"), (F.col("c") + F.col("node_id") % 7 - 3).alias("c2"))
    return G.pixel_line(n).select("id", "i", "r", "c")


STUBS = """, s as (select o_orderkey as id, cos(o_custkey / 1e2) as u1x, sin(o_custkey / 1e2) as u1y, cos(o_orderkey / 1e2) as u2x, sin(o_orderkey / 1e2) as u2y from orders),
dc as (select id, (greatest(0e0, u1x * 0.6e0 + u1y * 0.8e0) + greatest(0e0, -u2x * 0.6e0 - u2y * 0.8e0)) / 2 as d,
  greatest(0e0, -u1x * u2x - u1y * u2y) as c from s)"""


def _stubs(spark, sf):
    a, b = F.col("o_custkey") / 100.0, F.col("o_orderkey") / 100.0
    v = [F.cos(a), F.sin(a), F.cos(b), F.sin(b)]
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), "o_custkey",
        G.gap_direction_score(*v, F.lit(0.6), F.lit(0.8)).alias("d"), G.curvature(*v).alias("c"))


@query("prj21_gap_direction_curvature", STUBS + " select id, round(d, 6) as d, round(c, 6) as c from dc")
def _(spark, sf):
    return _stubs(spark, sf).select("id", F.round("d", 6).alias("d"), F.round("c", 6).alias("c"))


@query("prj22_width_similarity", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(1 - abs(l_quantity - l_linenumber) / greatest(l_quantity, l_linenumber), 8) as w,
  round(1 - abs(l_quantity / 60 - l_linenumber / 9e0) / greatest(l_quantity / 60, l_linenumber / 9e0, 1), 8) as w_train from lineitem""")
def _(spark, sf):
    q, n = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(X.width_similarity(q, n), 8).alias("w"),
        F.round(X.width_similarity(q / 60, n / 9.0, 1.0), 8).alias("w_train"))


@query("prj23_wcs", STUBS + """ select id, round(0.35e0 * d + 0.25e0 * (id % 101 / 1e2) + 0.2e0 * (id % 11 / 1e1) + 0.2e0 * c, 6) as wcs from dc""")
def _(spark, sf):
    s, w = F.col("id") % 101 / 100.0, F.col("id") % 11 / 10.0
    return _stubs(spark, sf).select("id", F.round(X.wcs(F.col("d"), s, w, F.col("c")), 6).alias("wcs"))


@query("prj24_heuristic_score", STUBS + """ select id, case when id % 5 = 0 then 0e0 else round(0.7e0 * d + 0.3e0 * c, 6) end as score from dc""")
def _(spark, sf):
    return _stubs(spark, sf).select("id", F.round(X.heuristic_score(F.col("d"), F.col("c"), F.col("id") % 5 == 0), 6).alias("score"))


@query("prj25_congestion_from_density", """
select r, c, round(1 + 4 * least(greatest(pop / p95, 0e0), 1e0), 6) as congestion
from fx_pix, (select quantile_cont(pop, 0.95) as p95 from fx_pix where pop > 0) q""")
def _(spark, sf):
    p = fx(spark, sf, "fx_pix")
    from netresil.operators.raster import percentile_or_one
    p95 = percentile_or_one(p, "pop", 0.95).select(F.col("top").alias("p95"))  # one row
    return p.join(F.broadcast(p95)).select("r", "c", F.round(X.congestion_from_density(F.col("pop"), F.col("p95")), 6).alias("congestion"))


@query("prj26_population_fallback", """
select incident_id, cast(floor(pi() * ((radius_m / 1000) * (radius_m / 1000)) * 11000 * 0.35e0) as bigint) as people from fx_incidents""")
def _(spark, sf):
    return fx(spark, sf, "fx_incidents").select("incident_id", X.population_fallback(F.col("radius_m")).alias("people"))


@query("prj28_default_od", """
select c_custkey as id, round(round_even(lat, 4) + 0.02e0, 4) as origin_lat, round(round_even(lat, 4) - 0.02e0, 4) as dest_lat
from (select c_custkey, 5 + (c_custkey * 104729) % 50000 / 1e3 as lat from customer) t""")
def _(spark, sf):
    return _lonlat(spark, sf).select("id", X.default_origin_lat(F.col("lat")).alias("origin_lat"), X.default_destination_lat(F.col("lat")).alias("dest_lat"))


@query("prj29_delta_row", """
select o_orderkey, o_totalprice > 250000 as improved, o_totalprice < 250000 as improved_inverted,
  printf('%.0f', floor(o_totalprice)) || '.0' as text from orders""")
def _(spark, sf):
    b, a = F.lit(250000.0), F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        "o_orderkey", X.improved(b, a).alias("improved"), X.improved(b, a, True).alias("improved_inverted"),
        X.fixed_text(F.floor(a).cast("double"), 1).alias("text"))


@query("prj30_route_status_label", f"""
select event_id, case event_type when 'click' then 'OK' when 'view' then 'ISO' else 'FAIL' end as label,
  case when event_type = 'error' then '{X.DISCONNECTED_HINT}' else event_type end as message from events""")
def _(spark, sf):
    t = F.col("event_type")
    status = F.when(t == "click", "success").when(t == "view", "isolated").otherwise(t)
    msg = F.when(t == "error", F.lit("No NAVIGABLE path between these points.")).otherwise(t)
    return table(spark, sf, "events").select("event_id", X.route_status_label(status).alias("label"), X.friendly_message(msg).alias("message"))


@query("prj31_percent", """
select user_id, count(*) as n, round(100e0 * count(*) filter (where event_type = 'click') / greatest(count(*) filter (where event_type = 'view'), 1), 6) as pct
from events group by user_id""")
def _(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("a"), F.count_if(F.col("event_type") == "view").alias("b"))
    return e.select("user_id", "n", F.round(X.percent(F.col("a"), F.col("b")), 6).alias("pct"))


@query("prj33_apply_defaults", """
select id, coalesce(weight_type, 'travel_time') as weight_type, coalesce(snap, 5000e0) as max_snap_dist_m, coalesce(radius, 800e0) as radius_m,
  case when start_lat is null then 'missing start_lat' else 'ok' end as reason
from (select c_custkey as id, case when c_nationkey = 3 then 'length_m' end as weight_type, case when c_nationkey > 20 then 500e0 end as snap,
  case when c_nationkey < 5 then 300e0 end as radius, case when c_mktsegment <> 'MACHINERY' then c_acctbal end as start_lat from customer) t""")
def _(spark, sf):
    from netresil.operators.requests import apply_defaults
    n = F.col("c_nationkey")
    req = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.when(n == 3, F.lit("length_m")).alias("weight_type"),
        F.when(n > 20, F.lit(500.0)).alias("max_snap_dist_m"), F.when(n < 5, F.lit(300.0)).alias("radius_m"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_acctbal")).alias("start_lat"))
    return apply_defaults(req, "route", ["start_lat"]).select("id", "weight_type", "max_snap_dist_m", "radius_m", "reason")


# ---- filters -------------------------------------------------------------

@query("flt01_clip_bbox", """
select id, lon, lat from (select c_custkey as id, 70 + (c_custkey * 7919) % 9000 / 1e3 as lon, 5 + (c_custkey * 104729) % 50000 / 1e3 as lat from customer) t
where lon between 72 and 73 and lat between 10 and 40""")
def _(spark, sf):
    from netresil.operators.cleaning import clip_bbox
    return clip_bbox(_lonlat(spark, sf), "lon", "lat", (72.0, 10.0, 73.0, 40.0))


@query("flt02_clean_nodata", """
select r, c, case when pop < 0 or isnan(pop) then 0 else pop end as pop from fx_pix""")
def _(spark, sf):
    return fx(spark, sf, "fx_pix").select("r", "c", X.clean_nodata(F.col("pop")).alias("pop"))


@query("flt03_valid_positive", "select r, c, pop from fx_pix where pop > 0")
def _(spark, sf):
    return fx(spark, sf, "fx_pix").select("r", "c", "pop").where(X.is_valid_positive(F.col("pop")))


@query("flt04_threshold_mask", "select r, c, cast(prob > 0.4e0 as int) as mask from fx_pix")
def _(spark, sf):
    from netresil.operators.raster import threshold_mask
    return threshold_mask(fx(spark, sf, "fx_pix").select("r", "c", F.col("prob").alias("value")), 0.40).select("r", "c", "mask")


@query("flt05_terminals", """
, d as (select n, count(*) as k from (select src as n from fx_trails union all select dst from fx_trails) t group by n)
select n as node_id from d where k = 1""")
def _(spark, sf):
    return GR.terminals(fx(spark, sf, "fx_trails"))


@query("flt06_drop_self_loops", """
select l_partkey as src, l_suppkey as dst, count(*) as n from lineitem where l_partkey <> l_suppkey group by 1, 2""")
def _(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return GR.drop_self_loops(e).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("flt07_candidate_gates", STUBS + """
select id, round(0.35e0 * d + 0.25e0 * (id % 101 / 1e2) + 0.2e0 * (1 - abs(w1 - w2) / greatest(w1, w2)) + 0.2e0 * c, 6) as wcs
from (select *, cast(id % 5 as double) as w1, cast(id % 7 as double) as w2 from dc) t
where d >= 0.1e0 and w1 >= 1 and w2 >= 1 and id % 13 <> 0
  and 0.35e0 * d + 0.25e0 * (id % 101 / 1e2) + 0.2e0 * (1 - abs(w1 - w2) / greatest(w1, w2)) + 0.2e0 * c >= 0.6e0""")
def _(spark, sf):
    from netresil.operators.healing import candidate_gates
    s = _stubs(spark, sf).select(
        F.col("id"), F.when(F.col("id") % 13 != 0, F.col("d")).alias("D"), F.col("c").alias("C"), (F.col("id") % 101 / 100.0).alias("S"),
        (F.col("id") % 5).cast("double").alias("w1"), (F.col("id") % 7).cast("double").alias("w2"))
    return candidate_gates(s, 0.6).select("id", F.round("wcs", 6).alias("wcs"))


@query("flt08_border_guard", """
select r, c, r between 5 and (select max(r) from fx_pix) - 5 and c between 5 and (select max(c) from fx_pix) - 5 as inside,
  case when r between 5 and (select max(r) from fx_pix) - 5 and c between 5 and (select max(c) from fx_pix) - 5 then prob else 0 end as width from fx_pix""")
def _(spark, sf):
    from netresil.operators.raster import border_guard, grid_shape
    p = fx(spark, sf, "fx_pix").select("r", "c", F.col("prob").alias("width"))
    return border_guard(p, grid_shape(p), "width", 5)


@query("flt11_in_bounds", """
select node_id as id, r + node_id % 11 - 5 as r, c + node_id % 7 - 3 as c from fx_nodes
where r + node_id % 11 - 5 between 0 and (select max(r) from fx_nodes) and c + node_id % 7 - 3 between 0 and (select max(c) from fx_nodes)""")
def _(spark, sf):
    from netresil.operators.raster import grid_shape, in_bounds
    n = fx(spark, sf, "fx_nodes")
    moved = n.select(F.col("node_id").alias("id"), (F.col("r") + F.col("node_id") % 11 - 5).alias("r"), (F.col("c") + F.col("node_id") % 7 - 3).alias("c"))
    return in_bounds(moved, grid_shape(n))


@query("flt12_density_flag", """
select p_brand, round(100e0 * count(*) filter (where p_size > 48) / count(*), 6) as pct,
  case when 100e0 * count(*) filter (where p_size > 48) / count(*) < 0.1e0 then 'too few'
    when 100e0 * count(*) filter (where p_size > 48) / count(*) > 30 then 'too many' else 'optimal' end as flag
from part group by p_brand""")
def _(spark, sf):
    g = table(spark, sf, "part").groupBy("p_brand").agg((100.0 * F.count_if(F.col("p_size") > 48) / F.count("*")).alias("pct"))
    return g.select("p_brand", F.round("pct", 6).alias("pct"), X.density_flag(F.col("pct")).alias("flag"))
