"""Pixel tables: sources, contrast, neighbourhoods, tiles, resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import fx, table
from checks.registry import query
from netresil.functions import expressions as X
from netresil.operators import raster as R
from netresil.operators import resample as RS
from netresil.operators.raster import Grid


def pix(spark, sf, band, name="value"):
    return fx(spark, sf, "fx_pix").select("r", "c", F.col(band).cast("double").alias(name))


def shape(spark, sf):
    n = table(spark, sf, "orders").count()
    side = int(n ** 0.5)
    return (-(-n // side), side)


def grid(spark, sf, px=100.0):
    """The lattice as a raster, row 0 in the south as the node ids run."""
    h, w = shape(spark, sf)
    return Grid(h, w, px, 0.0, 250000.0 - 50, 0.0, px, 2540000.0 - 50)


@query("src02_read_window", """
select r, c, prob as value from fx_pix where r >= 10 and r < 30 and c >= 5 and c < 25""")
def _(spark, sf):
    return R.read_window(pix(spark, sf, "prob"), 10, 30, 5, 25)


@query("agg04_numeric_summary", "select min(prob) as min, max(prob) as max, round(avg(prob), 6) as mean from fx_pix")
def _(spark, sf):
    return pix(spark, sf, "prob").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.round(F.avg("value"), 6).alias("mean"))


@query("agg05_raster_stats", """
select count(*) as cells, min(pop) as min, max(pop) as max, count(*) filter (where pop > 0) as valid, round(avg(pop) filter (where pop > 0), 6) as mean_valid,
  cast(floor(sum(pop) filter (where pop > 0)) as bigint) as total, max(r) + 1 as height, max(c) + 1 as width from fx_pix""")
def _(spark, sf):
    return R.raster_stats(pix(spark, sf, "pop")).withColumn("mean_valid", F.round("mean_valid", 6))


@query("agg06_percentile", """
, v as (select 1 as band, red as value from fx_pix union all select 2, green from fx_pix union all select 3, blue from fx_pix)
select band, round(quantile_cont(cast(value as double), 0.02), 6) as p2, round(quantile_cont(cast(value as double), 0.95), 6) as p95,
  round(quantile_cont(cast(value as double), 0.98), 6) as p98, count(*) as n from v group by band""")
def _(spark, sf):
    got = R.exact_percentiles(bands(spark, sf), "value", [0.02, 0.95, 0.98], ["band"])
    return got.select("band", *[F.round(f"p{i}", 6).alias(n) for i, n in enumerate(("p2", "p95", "p98"))], "n")


def bands(spark, sf):
    p = fx(spark, sf, "fx_pix")
    return p.select("r", "c", F.posexplode(F.array(*[F.col(b).cast("double") for b in ("red", "green", "blue")])).alias("band", "value")).withColumn(
        "band", F.col("band") + 1)


@query("agg06b_percentile_or_one", "select quantile_cont(pop, 0.95) as top from fx_pix where pop > 0")
def _(spark, sf):
    return R.percentile_or_one(pix(spark, sf, "pop"), "value", 0.95)


@query("agg12_coverage_pct", "select r, round(100e0 * sum(mask) / count(*), 6) as pct from fx_mask group by r")
def _(spark, sf):
    return R.coverage_pct(fx(spark, sf, "fx_mask"), F.col("mask") == 1, ["r"]).select("r", F.round("pct", 6).alias("pct"))


@query("agg13_threshold_sweep", """
select t as threshold, round(100e0 * count(*) filter (where prob > t) / count(*), 6) as pct,
  100e0 * count(*) filter (where prob > t) / count(*) between 1 and 10 as reasonable
from fx_pix, (values (0.3e0), (0.4e0), (0.5e0), (0.6e0), (0.7e0), (0.75e0), (0.8e0), (0.85e0), (0.9e0)) v(t) group by t""")
def _(spark, sf):
    return R.threshold_sweep(pix(spark, sf, "prob")).withColumn("pct", F.round("pct", 6))


NB = """, n as (select s.r, s.c, (select 1) as one, count(t.r) as neighbours from fx_skel s left join fx_skel t
  on t.r between s.r - 1 and s.r + 1 and t.c between s.c - 1 and s.c + 1 and not (t.r = s.r and t.c = s.c) group by s.r, s.c)"""


@query("agg17_breaks_per_km", NB + """
select count(*) as pixels, count(*) filter (where neighbours = 1) as endpoints,
  round(count(*) filter (where neighbours = 1) / 2e0 / greatest(count(*) * 10 / 1e3, 0.001e0), 6) as breaks_per_km from n""")
def _(spark, sf):
    return R.breaks_per_km(fx(spark, sf, "fx_skel"), 10.0).withColumn("breaks_per_km", F.round("breaks_per_km", 6))


@query("rst01_sar_db_fixed", """
select r, c, round((least(greatest(case when vv > 0 then 10 * log10(vv) else -30 end, -25e0), 5e0) + 25) / 30, 8) as s1,
  round((least(greatest(case when vv > 0 then 10 * log10(vv) else -30 end, -30e0), 5e0) + 30) / 35, 8) as l_band from fx_pix""")
def _(spark, sf):
    v = F.col("value")
    return pix(spark, sf, "vv").select("r", "c", F.round(X.sar_db_fixed(v, -25.0, 5.0), 8).alias("s1"), F.round(X.sar_db_fixed(v, -30.0, 5.0), 8).alias("l_band"))


@query("rst02_sar_db_percentile", """
, d as (select r, c, case when vv > 0 then 10 * log10(vv + 1e-10) else -30 end as db from fx_pix),
q as (select quantile_cont(db, 0.02) as a, quantile_cont(db, 0.98) as b from d where db > -30)
select r, c, round((least(greatest(db, a), b) - a) / (b - a + 1e-8), 6) as value from d, q""")
def _(spark, sf):
    return R.sar_db_percentile(pix(spark, sf, "vv")).select("r", "c", F.round("value", 6).alias("value"))


@query("rst03_norm01", """
, q as (select quantile_cont(vv, 0.02) as a, quantile_cont(vv, 0.98) as b from fx_pix where vv > 0)
select r, c, round(least(greatest((vv - a) / (b - a + 1e-6), 0e0), 1e0), 6) as value from fx_pix, q""")
def _(spark, sf):
    return R.norm01(pix(spark, sf, "vv")).select("r", "c", F.round("value", 6).alias("value"))


BANDQ = """, v as (select r, c, 1 as band, cast(red as double) as value from fx_pix union all select r, c, 2, green from fx_pix union all select r, c, 3, blue from fx_pix),
q as (select band, quantile_cont(value, 0.02) as a, quantile_cont(value, 0.98) as b from v group by band)"""


@query("rst04_stretch_uint8", BANDQ + """
select r, c, band, cast(floor((least(greatest(value, a), b) - a) / (b - a + 1e-6) * 255) as int) as value from v join q using (band)""")
def _(spark, sf):
    return R.stretch_uint8(bands(spark, sf), keys=["band"]).select("r", "c", "band", "value")


@query("rst05_stretch_unit", BANDQ + """
select r, c, band, round(case when a = b then value else (least(greatest(value, a), b) - a) / (b - a) end, 6) as value from v join q using (band)""")
def _(spark, sf):
    return R.stretch_unit(bands(spark, sf), keys=["band"]).select("r", "c", "band", F.round("value", 6).alias("value"))


@query("rst06_standardize", BANDQ + """
select r, c, band, round((value / 255 - case band when 1 then 0.485e0 when 2 then 0.456e0 else 0.406e0 end)
  / case band when 1 then 0.229e0 when 2 then 0.224e0 else 0.225e0 end, 6) as value, round((value - 0.5e0) / 0.5e0, 6) as centred from v""")
def _(spark, sf):
    b = bands(spark, sf).withColumn("centred", F.round(R.center(F.col("value")), 6))
    return R.standardize(b).select("r", "c", "band", F.round("value", 6).alias("value"), "centred")


ORIG = """, m as (select p_partkey as raster_id, p_size * 7 + 1 as height, p_size * 5 + 40 as width from part),
h as (select raster_id, unnest(list_distinct(list_append(range(0, greatest(0, height - 64) + 1, 48), greatest(0, height - 64)))) as r0 from m),
w as (select raster_id, unnest(list_distinct(list_append(range(0, greatest(0, width - 64) + 1, 48), greatest(0, width - 64)))) as c0 from m)"""


@query("rst07_tile_grid", ORIG + " select raster_id, r0, c0 from h join w using (raster_id)")
def _(spark, sf):
    m = table(spark, sf, "part").select(
        F.col("p_partkey").alias("raster_id"), (F.col("p_size") * 7 + 1).alias("height"), (F.col("p_size") * 5 + 40).alias("width"))
    return R.tile_grid(m, 64, 16)


TILES = """, m as (select max(r) + 1 as height, max(c) + 1 as width from fx_pix),
o as (select unnest(list_distinct(list_append(range(0, greatest(0, height - 48) + 1, 32), greatest(0, height - 48)))) as r0 from m),
p as (select unnest(list_distinct(list_append(range(0, greatest(0, width - 48) + 1, 32), greatest(0, width - 48)))) as c0 from m),
k as (select r0, c0, a.i as tr, b.i as tc, case when r0 + a.i < height then r0 + a.i else 2 * (height - 1) - r0 - a.i end as r,
  case when c0 + b.i < width then c0 + b.i else 2 * (width - 1) - c0 - b.i end as c from o, p, m, range(48) a(i), range(48) b(i)),
t as (select r0, c0, tr, tc, prob from k join fx_pix using (r, c))"""


@query("rst08_extract_tiles", TILES + " select r0, c0, count(*) as pixels, round(sum(prob), 4) as total, max(tr * 1000 + tc) as last from t group by r0, c0")
def _(spark, sf):
    t = R.extract_tiles(pix(spark, sf, "prob"), shape(spark, sf), 48, 16)
    return t.groupBy("r0", "c0").agg(F.count("*").alias("pixels"), F.round(F.sum("value"), 4).alias("total"), F.max(F.col("tr") * 1000 + F.col("tc")).alias("last"))


@query("agg14_stitch", TILES + " select r0 + tr as r, c0 + tc as c, round(least(greatest(avg(prob + (r0 + c0) / 1e3), 0e0), 1e0), 6) as value from t, m where r0 + tr < height and c0 + tc < width group by 1, 2")
def _(spark, sf):
    s = shape(spark, sf)
    t = R.extract_tiles(pix(spark, sf, "prob"), s, 48, 16).withColumn("value", F.col("value") + (F.col("r0") + F.col("c0")) / 1000.0)
    return R.stitch(t, s).select("r", "c", F.round("value", 6).alias("value"))


@query("flt10_empty_tile_filter", TILES + " select r0, c0, round(sum(prob), 4) as total from t group by r0, c0 having sum(prob) > 500")
def _(spark, sf):
    t = R.extract_tiles(pix(spark, sf, "prob"), shape(spark, sf), 48, 16)
    return R.empty_tile_filter(t, ["r0", "c0"], 500.0).withColumn("total", F.round("total", 4))


@query("rst09_flip_vertical", "select (select max(r) from fx_pix) - r as r, c, prob as value from fx_pix")
def _(spark, sf):
    return R.flip_vertical(pix(spark, sf, "prob"), shape(spark, sf)[0])


@query("rst10_focal_max", """
, a as (select r, c, max(prob) over (partition by r order by c range between 2 preceding and 2 following) as v from fx_pix)
select r, c, max(v) over (partition by c order by r range between 2 preceding and 2 following) as value from a""")
def _(spark, sf):
    return R.focal_max(pix(spark, sf, "prob"), 5)


@query("rst11_dilate", """
, o as (select a.i as dr, b.i as dc from range(-3, 4) a(i), range(-3, 4) b(i) where abs(a.i) + abs(b.i) <= 3)
select distinct r + dr as r, c + dc as c from fx_skel, o""")
def _(spark, sf):
    return R.dilate(fx(spark, sf, "fx_skel"), 3)


@query("rst12_neighbour_count", NB + " select r, c, neighbours from n")
def _(spark, sf):
    return R.neighbour_count(fx(spark, sf, "fx_skel"))


FULL = """, d as (select max(r) as h, max(c) as w from fx_mask),
full_mask as (select a.r, b.c, coalesce(m.mask, 0) as mask from (select unnest(range(0, h + 1)) as r from d) a
  join (select unnest(range(0, w + 1)) as c from d) b on true left join fx_mask m on m.r = a.r and m.c = b.c)"""


def full_mask(spark, sf):
    """The mask over the whole rectangle; cells past the last order are unset."""
    g = grid(spark, sf)
    return RS.burn(fx(spark, sf, "fx_mask").where(F.col("mask") == 1).select("r", "c"), g)


@query("rst13_distance_to_background", FULL + """
select m.r, m.c, round(sqrt(min((m.r - z.r) * (m.r - z.r) + (m.c - z.c) * (m.c - z.c))), 6) as dist
from full_mask m join full_mask z on z.mask = 0 and z.r between m.r - 12 and m.r + 12 and z.c between m.c - 12 and m.c + 12
where m.mask = 1 group by m.r, m.c""")
def _(spark, sf):
    return R.distance_to_background(full_mask(spark, sf)).select("r", "c", F.round("dist", 6).alias("dist"))


@query("rst15_classify_pixels", NB + """ select r, c, neighbours, case when neighbours = 1 then 'endpoint' when neighbours >= 3 then 'junction'
  when neighbours = 0 then 'lone' end as node_type from n""")
def _(spark, sf):
    return R.classify_pixels(fx(spark, sf, "fx_skel"), lone_pixels=True)


@query("rst16_flip_rotate_resize", """
, m as (select max(r) as h, max(c) as w from fx_pix), q as (select w - c as r, r as c, prob from fx_pix, m)
select 2 * r + a.i as r, 2 * c + b.i as c, prob as value from q, (values (0), (1)) a(i), (values (0), (1)) b(i)""")
def _(spark, sf):
    h, w = shape(spark, sf)
    t = R.rotate90(pix(spark, sf, "prob"), w)
    return R.resize_nearest(t, (w, h), (2 * w, 2 * h))


@query("rst16b_augment_tiles", """
, t as (select cast(floor(r / 32e0) as bigint) * 1000 + cast(floor(c / 32e0) as bigint) as tile, prob from fx_pix)
select tile, count(*) as pixels, round(sum(prob), 4) as total from t group by tile""")
def _(spark, sf):
    p = pix(spark, sf, "prob")
    t = p.select((F.floor(F.col("r") / 32) * 1000 + F.floor(F.col("c") / 32)).alias("tile"), (F.col("r") % 32).alias("r"), (F.col("c") % 32).alias("c"), "value")
    return R.augment(t, 32, "tile").groupBy("tile").agg(F.count("*").alias("pixels"), F.round(F.sum("value"), 4).alias("total"))


@query("rst17_road_aware_crop")
def _(spark, sf):
    m = fx(spark, sf, "fx_mask")
    t = m.select((F.floor(F.col("r") / 32) * 1000 + F.floor(F.col("c") / 32)).alias("tile"), (F.col("r") % 32).alias("r"), (F.col("c") % 32).alias("c"), "mask")
    return R.road_aware_crop(t, (32, 32), 16, 60)


@query("rst19_score_tiles")
def _(spark, sf):
    s = shape(spark, sf)
    t = R.extract_tiles(pix(spark, sf, "prob"), s, 48, 16)
    return R.stitch(R.score_tiles(t, lambda pdf: (pdf["value"] - pdf["value"].mean()) * 4), s)


# ---- joins on pixels ---------------------------------------------------------

@query("jon07_pixel_lookup", """
select n.node_id, n.r + 3 as r, n.c - 2 as c, p.prob as value from fx_nodes n left join fx_pix p on p.r = n.r + 3 and p.c = n.c - 2""")
def _(spark, sf):
    pts = fx(spark, sf, "fx_nodes").select("node_id", (F.col("r") + 3).alias("r"), (F.col("c") - 2).alias("c"))
    return RS.pixel_lookup(pts, pix(spark, sf, "prob"))


HALF = "(2 * i * ({b} - {a}) + n - ((2 * i * ({b} - {a}) + n) % (2 * n) + 2 * n) % (2 * n)) // (2 * n)"
LINE = f"""
, k as (select id, r1, c1, r2, c2, greatest(abs(r2 - r1), abs(c2 - c1)) as steps, greatest(abs(r2 - r1), abs(c2 - c1), 1) as n from l),
e as (select *, unnest(range(0, steps + 1)) as i from k),
px as (select id, i, steps, cast(r1 + {HALF.format(a='r1', b='r2')} as bigint) as r, cast(c1 + {HALF.format(a='c1', b='c2')} as bigint) as c from e)"""
SWAY = "r + node_id % 11 - 5 as r2, c + node_id % 7 - 3 as c2"


def lines(spark, sf):
    return fx(spark, sf, "fx_nodes").select(
        F.col("node_id").alias("id"), F.col("r").alias("r1"), F.col("c").alias("c1"),
        (F.col("r") + F.col("node_id") % 11 - 5).alias("r2"), (F.col("c") + F.col("node_id") % 7 - 3).alias("c2"))


@query("jon08_sample_line", f", l as (select node_id as id, r as r1, c as c1, {SWAY} from fx_nodes)" + LINE + """,
g as (select id, avg(prob) as mean, max(prob) as max, count(*) as met from px join fx_pix using (r, c) group by id)
select l.id, round(coalesce(mean, 0), 6) as mean, coalesce(max, 0) as max, coalesce(met, 0) as met from l left join g on g.id = l.id""")
def _(spark, sf):
    return RS.sample_line(lines(spark, sf), pix(spark, sf, "prob"), ["id"]).withColumn("mean", F.round("mean", 6))


@query("flt09_line_of_sight_veto", f", l as (select node_id as id, r as r1, c as c1, {SWAY} from fx_nodes)" + LINE + """,
g as (select id, max(prob) as top from px join fx_pix using (r, c) where i > 0 and i < steps group by id)
select l.id, greatest(abs(r2 - r1), abs(c2 - c1)) + 1 > 2 and coalesce(top, 0) < 0.55e0 as vetoed from l left join g on g.id = l.id""")
def _(spark, sf):
    ln = lines(spark, sf)
    s = RS.sample_line(ln, pix(spark, sf, "prob"), ["id"], interior=True)
    long = F.greatest(F.abs(F.col("r2") - F.col("r1")), F.abs(F.col("c2") - F.col("c1"))) + 1 > 2
    return ln.join(s, "id").select("id", (long & (F.col("max") < 0.55)).alias("vetoed"))


@query("jon09_align_bilinear", """
, m as (select max(r) + 1 as h, max(c) + 1 as w from fx_pix),
cells as (select a.i as dr, b.j as dc from (select unnest(range(0, 2 * h)) as i from m) a, (select unnest(range(0, 2 * w)) as j from m) b),
f as (select dr, dc, (dr + 0.5e0) / 2 - 0.5e0 as fr, (dc + 0.5e0) / 2 - 0.5e0 as fc from cells),
k as (select dr, dc, cast(floor(fr) as bigint) + di as r, cast(floor(fc) as bigint) + dj as c,
  (case di when 1 then fr - floor(fr) else 1 - (fr - floor(fr)) end) * (case dj when 1 then fc - floor(fc) else 1 - (fc - floor(fc)) end) as wt
  from f, (values (0), (1)) x(di), (values (0), (1)) y(dj))
select dr as r, dc as c, round(sum(wt * prob) / sum(wt), 9) as value from k join fx_pix using (r, c) where wt > 0 group by dr, dc""")
def _(spark, sf):
    g = grid(spark, sf)
    fine = Grid(g.height * 2, g.width * 2, 50.0, 0.0, g.c, 0.0, 50.0, g.f)
    return RS.align_bilinear(pix(spark, sf, "prob"), g, fine).withColumn("value", F.round("value", 9))


@query("jon10_align_sum", """
, p as (select r, c, pop from fx_pix where pop > 0),
s as (select k.r as r, l.c as c, pop * (least(p.r + 1, (k.r + 1) * 2.5e0) - greatest(p.r, k.r * 2.5e0)) * (least(p.c + 1, (l.c + 1) * 2.5e0) - greatest(p.c, l.c * 2.5e0)) as part
  from p join range(0, 100000) k(r) on k.r * 2.5e0 < p.r + 1 and (k.r + 1) * 2.5e0 > p.r
  join range(0, 100000) l(c) on l.c * 2.5e0 < p.c + 1 and (l.c + 1) * 2.5e0 > p.c)
select r, c, round(sum(part), 4) as value from s group by r, c""" .replace("range(0, 100000) k(r)", "(select unnest(range(0, (select max(r) + 2 from fx_pix))) as r) k").replace(
    "range(0, 100000) l(c)", "(select unnest(range(0, (select max(c) + 2 from fx_pix))) as c) l"))
def _(spark, sf):
    g = grid(spark, sf)
    coarse = Grid(int(g.height / 2.5) + 1, int(g.width / 2.5) + 1, 250.0, 0.0, g.c, 0.0, 250.0, g.f)
    p = pix(spark, sf, "pop").where(F.col("value") > 0)
    return RS.align_sum(p, g, coarse).withColumn("value", F.round("value", 4))


@query("jon11_stack_bands", "select r, c, vv as a, vh as b, round(0.5e0 * vv + 0.5e0 * vh, 8) as mean from fx_pix")
def _(spark, sf):
    return R.stack_bands(pix(spark, sf, "vv"), pix(spark, sf, "vh")).withColumn("mean", F.round("mean", 8))


@query("jon18_rasterize_lines", """
, g as (select max(r) as h, max(c) as w from fx_pix),
s as (select a.x as x1, a.y as y1, b.x as x2, b.y as y2 from fx_trails e join fx_nodes a on a.node_id = e.src join fx_nodes b on b.node_id = e.dst),
s1 as (select *, unnest(range(cast(floor((least(y1, y2) - 2540000) / 50 - 1) as bigint), cast(ceil((greatest(y1, y2) - 2540000) / 50 + 2) as bigint))) as r from s),
s2 as (select *, unnest(range(cast(floor((least(x1, x2) - 250000) / 50 - 1) as bigint), cast(ceil((greatest(x1, x2) - 250000) / 50 + 2) as bigint))) as c from s1),
q as (select x1, y1, x2, y2, r, c, 250000 + c * 50e0 as px, 2540000 + r * 50e0 as py from s2),
t as (select *, greatest(0e0, least(1e0, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) as t from q)
select distinct r, c from t, g where sqrt((px - x1 - t * (x2 - x1)) * (px - x1 - t * (x2 - x1)) + (py - y1 - t * (y2 - y1)) * (py - y1 - t * (y2 - y1))) <= 40
  and r between 0 and 2 * h + 1 and c between 0 and 2 * w + 1""")
def _(spark, sf):
    from netresil.operators.spatial import edge_endpoints
    h, w = shape(spark, sf)
    g = Grid(2 * h, 2 * w, 50.0, 0.0, 250000.0 - 25, 0.0, 50.0, 2540000.0 - 25)
    segs = edge_endpoints(fx(spark, sf, "fx_trails"), fx(spark, sf, "fx_nodes"))
    return RS.rasterize_lines(segs, g, 0.8)


@query("jon19_neighbours8", """
select s.r, s.c, t.r as r2, t.c as c2 from fx_skel s join fx_skel t
  on t.r between s.r - 1 and s.r + 1 and t.c between s.c - 1 and s.c + 1 and not (t.r = s.r and t.c = s.c)""")
def _(spark, sf):
    return R.neighbours8(fx(spark, sf, "fx_skel"))


@query("set05_intersect_masks", "select r, c from fx_skel intersect select r, c from fx_mask where mask = 1")
def _(spark, sf):
    return fx(spark, sf, "fx_skel").intersect(fx(spark, sf, "fx_mask").where(F.col("mask") == 1).select("r", "c"))
