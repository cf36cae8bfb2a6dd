"""Aggregations, windows, catalogs, learning, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import fx, table
from checks.graphs import LADDER
from checks.rasters import pix
from checks.registry import query
from netresil.functions import expressions as X
from netresil.operators import catalog as CT
from netresil.operators import graph as GR
from netresil.operators import history as H
from netresil.operators import learning as L
from netresil.operators import metrics as M
from netresil.operators import reports as RP
from netresil.session import cut_lineage, ensure_checkpoint_dir


def scratch(spark, name):
    import uuid
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---- aggregations -------------------------------------------------------------

@query("agg11_band_counts", """
select count(*) filter (where prob >= 0.7e0) as high, count(*) filter (where prob >= 0.3e0 and prob < 0.7e0) as mid, count(*) filter (where prob < 0.3e0) as low from fx_pix""")
def _(spark, sf):
    return GR.band_counts(pix(spark, sf, "prob", "criticality"))


LOGIT = "(score - 5e-1) * 6"
CONF = f"""select cast(sum(case when 1 / (1 + exp(-{LOGIT})) > 0.4e0 and label = 1 then 1 else 0 end) as bigint) as tp,
  cast(sum(case when 1 / (1 + exp(-{LOGIT})) > 0.4e0 and label = 0 then 1 else 0 end) as bigint) as fp,
  cast(sum(case when 1 / (1 + exp(-{LOGIT})) > 0.4e0 then 0 else label end) as bigint) as fn from fx_scores"""


def scored(spark, sf):
    return fx(spark, sf, "fx_scores").withColumn("logit", (F.col("score") - 0.5) * 6)


@query("agg15_confusion_metrics", f"""
, k as ({CONF})
select tp, fp, fn, round(tp / (tp + fp + fn + 1e-6), 6) as iou, round(2 * tp / (2 * tp + fp + fn + 1e-6), 6) as dice,
  round(tp / (tp + fp + 1e-6), 6) as precision, round(tp / (tp + fn + 1e-6), 6) as recall from k""")
def _(spark, sf):
    m = M.confusion_metrics(scored(spark, sf), "logit", "label")
    return m.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("iou", "dice", "precision", "recall")])


@query("agg16_loss_metrics", f"""
, s as (select cast(label as double) as y, {LOGIT} as x, 1 / (1 + exp(-{LOGIT})) as p from fx_scores),
t as (select avg(-3 * y * ln(p) - (1 - y) * ln(1 - p)) as wbce, avg(-y * ln(p) - (1 - y) * ln(1 - p)) as bce, sum(p * y) as tp, sum(p * (1 - y)) as fp,
  sum((1 - p) * y) as fn, sum(p) as sp, sum(y) as sy from s),
u as (select *, 1 - (tp + 1) / (tp + 0.3e0 * fp + 0.7e0 * fn + 1) as tv, 1 - (2 * tp + 1) / (sp + sy + 1) as dl from t)
select round(wbce, 6) as bce, round(tv, 6) as tversky, round(0.6e0 * tv + 0.4e0 * wbce, 6) as road_loss, round(dl, 6) as dice_loss, round(0.5e0 * dl + 0.5e0 * bce, 6) as dice_bce from u""")
def _(spark, sf):
    m = M.loss_metrics(scored(spark, sf), "logit", "label")
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


STATUS = "case when o_orderstatus = 'F' then 'prepared' when o_totalprice < 100000 then 'blank' when o_orderstatus = 'P' then 'no_match' else 'failed' end"


@query("agg18_prep_tally", f"""
select o_orderpriority as city, count(*) filter (where s = 'prepared') as prepared, count(*) filter (where s = 'blank') as blank,
  count(*) filter (where s = 'no_match') as no_match, count(*) filter (where s = 'failed') as failed
from (select o_orderpriority, {STATUS} as s from orders) t group by 1""")
def _(spark, sf):
    st = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("city"), F.expr(STATUS).alias("status"))
    return CT.prep_tally(st, ["prepared", "blank", "no_match", "failed"])


@query("agg19_class_feature_means", """
select label, count(*) as n, round(avg(score), 6) as D, round(avg(l_linenumber / 7e0), 6) as S, round(avg(l_suppkey / 1e2), 6) as W, round(avg(l_partkey / 1e3), 6) as C
from fx_scores group by label""")
def _(spark, sf):
    m = L.class_feature_means(features(spark, sf))
    return m.select("label", "n", *[F.round(c, 6).alias(c) for c in L.FEATURES])


def features(spark, sf):
    return fx(spark, sf, "fx_scores").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "label", F.col("score").alias("D"), (F.col("l_linenumber") / 7.0).alias("S"),
        (F.col("l_suppkey") / 100.0).alias("W"), (F.col("l_partkey") / 1000.0).alias("C"))


@query("agg21_fit_bounds", """
select o_orderpriority as layer, min(o_totalprice) as min_lon, min(o_custkey) as min_lat, max(o_totalprice) as max_lon, max(o_custkey) as max_lat from orders group by 1""")
def _(spark, sf):
    return RP.fit_bounds(table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("layer"), F.col("o_totalprice").alias("lon"), F.col("o_custkey").alias("lat")), ["layer"])


@query("agg22_label_stats", "select event_type as outcome, count(*) as n from events group by event_type")
def _(spark, sf):
    return L.label_stats(table(spark, sf, "events").select(F.col("event_type").alias("outcome")))


@query("agg23_mean_over_samples", """
select l_suppkey, round(avg(m), 6) as mean_score from (select l_suppkey, l_orderkey, avg(score) as m from fx_scores group by 1, 2) t group by 1""")
def _(spark, sf):
    return M.mean_over_samples(fx(spark, sf, "fx_scores"), ["l_suppkey"], ["l_orderkey"], "score").withColumn("mean_score", F.round("mean_score", 6))


# ---- windows, order, sets -------------------------------------------------------

def history(spark, sf):
    e = table(spark, sf, "events")
    one = fx(spark, sf, "fx_history").select(F.lit("all").alias("run"), "epoch", "val_iou")
    per = e.groupBy(F.col("event_type").alias("run"), F.date_trunc("day", "ts").alias("d")).agg((F.count("*") / 100.0).alias("val_iou"))
    from pyspark.sql import Window
    per = per.withColumn("epoch", F.row_number().over(Window.partitionBy("run").orderBy("d"))).select("run", "epoch", "val_iou")
    return one.unionByName(per)


HIST = """, h as (select 'all' as run, epoch, val_iou from fx_history union all
  select event_type, cast(row_number() over (partition by event_type order by d) as int), n / 1e2 from (select event_type, date_trunc('day', ts) as d, count(*) as n from events group by 1, 2) t)"""


@query("win04_last_n_trend", HIST + """
, k as (select *, row_number() over (partition by run order by epoch desc) as j from h),
t as (select run, max(val_iou) filter (where j = 1) - max(val_iou) filter (where j = 5) as delta, count(*) as n from k where j <= 5 group by run)
select run, round(delta, 6) as delta, case when delta > 0.005e0 then 'improving' when delta > -0.005e0 then 'plateauing' else 'declining' end as trend from t where n >= 5""")
def _(spark, sf):
    return H.last_n_trend(history(spark, sf)).withColumn("delta", F.round("delta", 6))


@query("win05_best_and_last", HIST + """
, b as (select run, epoch, val_iou, row_number() over (partition by run order by val_iou desc, epoch) as k, row_number() over (partition by run order by epoch desc) as j from h)
select run, max(epoch) filter (where k = 1) as best_epoch, max(val_iou) as best, max(epoch) as last_epoch, max(val_iou) filter (where j = 1) as last, count(*) as epochs from b group by run""")
def _(spark, sf):
    return H.best_and_last(history(spark, sf))


@query("win06_early_stop", HIST + """
, a as (select *, val_iou > coalesce(max(val_iou) over (partition by run order by epoch rows between unbounded preceding and 1 preceding), 0) as improved from h),
b as (select *, sum(case when improved then 1 else 0 end) over (partition by run order by epoch) as g from a),
d as (select *, row_number() over (partition by run, g order by epoch) - case when g = 0 then 0 else 1 end as stale from b),
e as (select *, min(epoch) filter (where stale >= 3) over (partition by run) as stop_epoch, max(val_iou) over (partition by run order by epoch) as best from d)
select run, epoch, best, improved, cast(stale as int) as stale, stop_epoch, epoch % 5 = 0 as save, stop_epoch is null or epoch <= stop_epoch as ran from e""")
def _(spark, sf):
    return H.early_stop(history(spark, sf), 3)


@query("win07_baseline_delta", HIST + """
select run, epoch, val_iou, round(val_iou - 0.2155e0, 8) as delta, round((val_iou - 0.2155e0) / 0.2155e0 * 100, 6) as delta_pct from h""")
def _(spark, sf):
    return H.baseline_delta(history(spark, sf)).select("run", "epoch", "val_iou", F.round("delta", 8).alias("delta"), F.round("delta_pct", 6).alias("delta_pct"))


CURVE = """, g as (select score, sum(label) as pos, count(*) as n from fx_scores group by score),
curve as (select score as threshold, cast(sum(pos) over (order by score desc) as bigint) as tp, sum(n) over (order by score desc) as seen, (select sum(label) from fx_scores) as total from g),
pr as (select threshold, tp, tp * 1e0 / seen as precision, tp * 1e0 / total as recall from curve)"""


@query("win08_pr_curve", CURVE + " select threshold, tp, round(precision, 8) as precision, round(recall, 8) as recall from pr")
def _(spark, sf):
    c = M.pr_curve(fx(spark, sf, "fx_scores"))
    return c.select("threshold", "tp", F.round("precision", 8).alias("precision"), F.round("recall", 8).alias("recall"))


BEST = CURVE + """, b as (select threshold, 2 * precision * recall / (precision + recall + 1e-9) as f1 from pr order by 2 desc, 1 limit 1)"""


@query("win09_best_f1_threshold", BEST + " select threshold, round(f1, 8) as f1 from b")
def _(spark, sf):
    return M.best_f1_threshold(M.pr_curve(fx(spark, sf, "fx_scores"))).select("threshold", F.round("f1", 8).alias("f1"))


@query("mll07_f1_at_threshold", BEST + """
, k as (select count(*) filter (where s.score >= b.threshold and label = 1) as tp, count(*) filter (where s.score >= b.threshold and label = 0) as fp,
  count(*) filter (where s.score < b.threshold and label = 1) as fn from fx_scores s, b)
select tp, fp, fn, round(2e0 * tp / (2 * tp + fp + fn), 8) as f1 from k""")
def _(spark, sf):
    s = fx(spark, sf, "fx_scores")
    return M.f1_at(s, M.best_f1_threshold(M.pr_curve(s))).withColumn("f1", F.round("f1", 8))


@query("win11_element_at_fraction", """
, s as (select l_orderkey, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as i, count(*) over (partition by l_orderkey) as n from lineitem)
select l_orderkey, max(l_partkey) filter (where i = n // 3) as third, max(l_partkey) filter (where i = n // 2) as middle from s group by l_orderkey""")
def _(spark, sf):
    from netresil.operators.requests import element_at_fraction
    s = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    p = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(s)), lambda x: x["l_partkey"]).alias("path"))
    return p.select("l_orderkey", element_at_fraction("path", 3).alias("third"), element_at_fraction("path", 2).alias("middle"))


@query("srt01_rank_candidates", "select score, l_orderkey as ni, l_partkey as nj from fx_scores order by score desc, ni, nj")
def _(spark, sf):
    from netresil.operators.healing import rank_candidates
    return rank_candidates(fx(spark, sf, "fx_scores").select("score", F.col("l_orderkey").alias("ni"), F.col("l_partkey").alias("nj")))


@query("srt02_top_k_segments", f"""
, s as (select l_suppkey as incident_id, l_orderkey as src, l_partkey as dst, l_quantity as score, row_number() over (partition by l_suppkey order by l_quantity desc, l_orderkey, l_partkey) as k,
  count(*) over (partition by l_suppkey) as n from lineitem)
select incident_id, cast(k as int) as rank, src, dst, score, greatest(0, n - 8) as more from s where k <= 8""")
def _(spark, sf):
    s = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("incident_id"), F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("score"))
    return RP.top_k_segments(s)


BANDS = """case c_custkey % 5 when 0 then 'HHHH' when 1 then 'VVVV' when 2 then 'HH' when 3 then 'HV' else 'VHVH' end"""


@query("srt05_first_present_band", f"""
, a as (select c_nationkey as scene, {BANDS} as band from customer)
select scene, coalesce(max(band) filter (where band = 'HHHH'), max(band) filter (where band = 'VVVV'), max(band) filter (where band = 'HH')) as band from a group by scene""")
def _(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("scene"), F.expr(BANDS).alias("band"))
    return CT.first_present_band(a, ["HHHH", "VVVV", "HH"])


@query("set03_union_runs", """
select 'orders' as run, o_orderkey as k, o_totalprice as v from orders union all select 'customers', c_custkey, c_acctbal from customer union all select 'suppliers', s_suppkey, s_acctbal from supplier""")
def _(spark, sf):
    from netresil.operators.requests import union_runs
    return union_runs({
        "orders": table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v")),
        "customers": table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")),
        "suppliers": table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))})


@query("set04_stack_labels", """
select l_orderkey as k, l_partkey as p, 1 as label from lineitem where l_returnflag = 'R' union all select l_orderkey, l_partkey, 0 from lineitem where l_returnflag <> 'R'""")
def _(spark, sf):
    from netresil.operators.requests import stack_labels
    li = table(spark, sf, "lineitem")
    part = lambda c: li.where(c).select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"))
    return stack_labels(part("l_returnflag = 'R'"), part("l_returnflag <> 'R'"))


# ---- catalogs -------------------------------------------------------------------

@query("src03_axis_window", """
, s as (select cast(side as bigint) as n from fx_dim),
a as (select distinct 'x' as axis, c as idx, 250000 + c * 100e0 as coord from fx_nodes union all
  select distinct 'y', r, 2540000 + ((select max(r) from fx_nodes) - r) * 100e0 from fx_nodes),
g as (select axis, count(*) as n, max(coord) filter (where idx = 1) > max(coord) filter (where idx = 0) as up, count(*) filter (where coord < 251234) as below,
  count(*) filter (where coord <= 252345) as upto, count(*) filter (where coord > 252345) as above, count(*) filter (where coord >= 251234) as from_lo from a group by axis)
select axis, greatest(0, case when up then below else above end - 1) as start, least(n, case when up then upto else from_lo end + 1) as stop, up as flip from g""")
def _(spark, sf):
    n = fx(spark, sf, "fx_nodes")
    top = n.agg(F.max("r")).first()[0]
    a = n.select("c").distinct().select(F.lit("x").alias("axis"), F.col("c").alias("idx"), (250000 + F.col("c") * 100.0).alias("coord")).unionByName(
        n.select("r").distinct().select(F.lit("y").alias("axis"), F.col("r").alias("idx"), (2540000 + (F.lit(top) - F.col("r")) * 100.0).alias("coord")))
    return CT.axis_window(a, 251234.0, 252345.0)


@query("src04_buffer_bbox", """
, b as (select c_nationkey as id, min(c_acctbal) as x0, min(c_custkey) * 1e0 as y0, max(c_acctbal) as x1, max(c_custkey) * 1e0 as y1 from customer group by 1)
select id, round(x0 - (x1 - x0) * 0.1e0, 6) as min_x, round(y0 - (y1 - y0) * 0.1e0, 6) as min_y, round(x1 + (x1 - x0) * 0.1e0, 6) as max_x, round(y1 + (y1 - y0) * 0.1e0, 6) as max_y from b""")
def _(spark, sf):
    from netresil.sources.rasters import buffer_bbox
    b = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(
        F.min("c_acctbal").alias("min_x"), (F.min("c_custkey") * 1.0).alias("min_y"), F.max("c_acctbal").alias("max_x"), (F.max("c_custkey") * 1.0).alias("max_y"))
    out = buffer_bbox(b)
    return out.select("id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("src10_pending_tiles", "select p_partkey, stem from fx_tiles where not has_sar")
def _(spark, sf):
    t = fx(spark, sf, "fx_tiles")
    return CT.pending_tiles(t.select("p_partkey", "stem"), t.where("has_sar").select("stem"), ["stem"])


@query("jon12_match_tiles", """
select city, stem, 'i/' || stem as image_path, 'm/' || stem || '_mask' as mask_path, 's/' || stem || '_sar' as sar_path from fx_tiles where has_mask and has_sar""")
def _(spark, sf):
    t = fx(spark, sf, "fx_tiles")
    part = lambda c, pre, suf: t.where(c).select("city", F.concat("stem", F.lit(suf)).alias("stem"), F.concat(F.lit(pre), "stem", F.lit(suf)).alias("path"))
    return CT.match_tiles(part("true", "i/", ""), part("has_mask", "m/", "_mask"), part("has_sar", "s/", "_sar"))


VEC = "case when p_partkey % 5 = 0 then stem when p_partkey % 5 = 1 then replace(stem, 'PS-RGB', 'geojson_roads') when p_partkey % 5 = 2 then 'v_' || stem || '_x' when p_partkey % 5 = 3 then 'roads_' || cast(p_partkey as varchar(20)) end"


TOKENS = "values " + ", ".join(f"('{a}', '{b}', {1 + i * len(CT.VECTOR_TOKENS) + j})" for i, a in enumerate(CT.IMAGE_TOKENS) for j, b in enumerate(CT.VECTOR_TOKENS))


@query("jon13_fuzzy_match_tiles", f"""
, t as (select p_partkey, concat(stem, '_', cast(p_partkey as varchar(20))) as stem from fx_tiles),
img as (select distinct stem from t), vec as (select distinct v as vector from (select {VEC} as v from t) q where v is not null),
part as (select stem, string_split(replace(stem, '-', '_'), '_') as p from img),
tail as (select stem, n + 20 as priority, array_to_string(p[len(p) - n + 1 : len(p)], '_') as part from part, (values (1), (2), (3), (4)) k(n) where len(p) >= n),
digit as (select stem, k, p[len(p) - k] as part from (select stem, p, unnest(range(len(p))) as k from part) q where regexp_full_match(p[len(p) - k], '[0-9]+')),
every as (select stem, vector, 0 as priority from img join vec on stem = vector
  union all select stem, vector, x.i from img, ({TOKENS}) x(a, b, i) join vec on vector = replace(stem, a, b)
  union all select stem, vector, priority from tail join vec on contains(vector, part)
  union all select stem, vector, cast(30 + k as int) from digit join vec on suffix(vector, part))
select stem, arg_min(vector, (priority, vector)) as vector, cast(min(priority) as int) as priority from every group by stem""")
def _(spark, sf):
    t = fx(spark, sf, "fx_tiles").withColumn("stem", F.concat("stem", F.lit("_"), F.col("p_partkey").cast("string")))
    vec = t.select(F.expr(VEC.replace("varchar(20)", "string")).alias("stem")).where("stem is not null")
    return CT.fuzzy_match_tiles(t.select("stem"), vec)


@query("jon17_check_alignment", """
, m as (select p_partkey as id, 100 + p_size % 3 as h, 32643 + p_size % 2 as epsg, 1e1 + (p_size % 5) / 4e0 as a, p_size % 7 as s from part)
select id as stem, concat_ws(';', case when h <> 100 then 'dim sar' end, case when epsg <> 32643 then 'crs sar' end,
  case when a - 10 >= 1e-3 then 'transform sar' end, case when (a - 10) * 100 >= 1 then 'bounds sar' end,
  case when a - 10 > 0.5e0 then 'pixel size sar' end, case when s = 0 then 'sar all zeros' end) as failures,
  h = 100 and epsg = 32643 and a < 10.0005e0 and s <> 0 as ok from m""")
def _(spark, sf):
    def meta(h, epsg, a):
        return F.struct(h.alias("height"), F.lit(100).alias("width"), epsg.alias("epsg"),
                        F.array(a, F.lit(0.0), F.lit(5.0), F.lit(0.0), F.lit(-10.0), F.lit(9.0)).alias("t"), F.array(F.lit(5.0), F.lit(9.0), 5 + a * 100, F.lit(1009.0)).alias("b"))
    s = F.col("p_size")
    ref = meta(F.lit(100), F.lit(32643), F.lit(10.0))
    sets = table(spark, sf, "part").select(
        F.col("p_partkey").alias("stem"), ref.alias("opt"), meta(100 + s % 3, 32643 + s % 2, 10 + (s % 5) / 4.0).alias("sar"), ref.alias("msk"), (s % 7).alias("sar_sum"))
    return CT.check_alignment(sets).withColumn("failures", F.array_join("failures", ";"))


# ---- learning ---------------------------------------------------------------------

ORDER = ["h", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax"]


def items(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax", "l_returnflag")
    return li.withColumn("h", (F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729) % 10007).withColumn("label", (F.col("l_returnflag") == "R").cast("int"))


ITEMS = """, t as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_tax, (l_orderkey * 7919 + l_partkey * 104729) % 10007 as h,
  case when l_returnflag = 'R' then 1 else 0 end as label from lineitem)"""
BY = "order by h, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_tax"


@query("mll01_split3", ITEMS + f"""
, k as (select *, row_number() over ({BY}) - 1 as pos, count(*) over () as n from t),
s as (select *, cast(floor(n * 0.15e0) as bigint) as v from k)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, case when pos < n - 2 * v then 'train' when pos < n - v then 'val' else 'test' end as split from s""")
def _(spark, sf):
    return L.split3(items(spark, sf), ORDER).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "split")


@query("mll02_cap_per_tile", ITEMS + """
, k as (select *, row_number() over (partition by l_suppkey, label order by h, l_orderkey, l_linenumber, l_partkey, l_quantity) as n from t)
select l_suppkey, label, l_orderkey, l_linenumber, l_partkey, l_quantity from k where n <= case when label = 1 then 15 else 45 end""")
def _(spark, sf):
    from pyspark.sql.functions import struct
    out = L.cap_per_tile(items(spark, sf), "l_suppkey", "label", {1: 15, 0: 45}, struct("h", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"))
    return out.select("l_suppkey", "label", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("mll03_balance", ITEMS + f"""
, c as (select least(count(*) filter (where label = 1), count(*) filter (where label = 0) // 3) as m from t),
k as (select *, row_number() over (partition by label {BY}) as pos from t)
select label, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from k, c where pos <= case when label = 1 then m else 3 * m end""")
def _(spark, sf):
    return L.balance(items(spark, sf), "label", ORDER).select("label", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("mll04_standard_scale", """
, s as (select avg(score) as m, stddev_pop(score) as d, avg(l_partkey / 1e3) as m2, stddev_pop(l_partkey / 1e3) as d2 from fx_scores)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round((score - m) / d, 6) as D, round((l_partkey / 1e3 - m2) / d2, 6) as C from fx_scores, s""")
def _(spark, sf):
    f = features(spark, sf)
    out = L.standard_scale(f, L.fit_scale(f, ["D", "C"]), ["D", "C"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("D", 6).alias("D"), F.round("C", 6).alias("C"))


def newton_sql(steps: int) -> str:
    """The fit as SQL: full Newton steps, each with its sums and a solution of the five equations by elimination."""
    k = range(5)
    raw = {"x0": "score", "x1": "l_linenumber / 7e0", "x2": "l_suppkey / 100e0", "x3": "l_partkey / 1000e0"}
    flat = ", ".join(f"avg({e}) as m{i}, coalesce(nullif(stddev_pop({e}), 0), 1) as d{i}" for i, e in enumerate(raw.values()))
    scaled = ", ".join(f"({e} - m{i}) / d{i} as {x}" for i, (x, e) in enumerate(raw.items()))
    out = [
        f", fs as materialized (select {flat} from fx_scores)",
        f"lx as materialized (select l_orderkey, l_linenumber, l_partkey, l_suppkey, {scaled}, 1e0 as x4, cast(label as double) as y from fx_scores, fs)",
        "k0 as (select " + ", ".join(f"0e0 as b{i}" for i in k) + ")",
    ]
    for n in range(steps):
        z = " + ".join(f"b{i} * x{i}" for i in k)
        sums = [f"sum((p - y) * x{i}) + {'any_value(b%d)' % i if i < 4 else '0'} as g{i}" for i in k]
        sums += [f"sum(p * (1 - p) * x{i} * x{j}) + {1 if i == j and i < 4 else 0} as h{i}{j}" for i in k for j in k if j <= i]
        sums += [f"any_value(b{i}) as b{i}" for i in k]
        out.append(f"s{n} as materialized (select {', '.join(sums)} from (select lx.*, q.*, 1 / (1 + exp(-({z}))) as p from lx, k{n} q) t)")
        sub = lambda i, top: "".join(f" - l{i}{m} * l{top}{m} * e{m}" for m in range(top))
        levels = []
        for j in k:
            levels += [[f"h{j}{j}{sub(j, j)} as e{j}"], [f"(h{i}{j}{sub(i, j)}) / e{j} as l{i}{j}" for i in range(j + 1, 5)]]
        levels += [[f"-g{i}" + "".join(f" - l{i}{m} * u{m}" for m in range(i)) + f" as u{i}"] for i in k]
        levels += [[f"u{i} / e{i}" + "".join(f" - l{m}{i} * v{m}" for m in range(i + 1, 5)) + f" as v{i}"] for i in reversed(k)]
        solved = f"s{n}"
        for level in filter(None, levels):
            solved = f"(select *, {', '.join(level)} from {solved}) t"
        out.append(f"k{n + 1} as materialized (select {', '.join(f'b{i} + v{i} as b{i}' for i in k)} from {solved})")
    return ",\n".join(out)


NEWTON = newton_sql(8)
FORMULA = NEWTON + """
select round(b0, 6) as w_D, round(b1, 6) as w_S, round(b2, 6) as w_W, round(b3, 6) as w_C, round(b4, 6) as b, 5e-1 as threshold, 'gap-logistic-1' as version from k8"""


def fitted(spark, sf):
    f = cut_lineage(features(spark, sf))
    scaled = cut_lineage(L.standard_scale(f, L.fit_scale(f, L.FEATURES), L.FEATURES))
    return scaled, L.logistic_fit(scaled)


def six(df):
    return df.withColumns({k: F.round(k, 6) for k in ["w_D", "w_S", "w_W", "w_C", "b"]})


@query("mll05_logistic_fit", FORMULA)
def _(spark, sf):
    _, model = fitted(spark, sf)
    return six(L.formula(spark, model, 0.5))


@query("mll06_logistic_score", NEWTON + """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(1 / (1 + exp(-(b0 * x0 + b1 * x1 + b2 * x2 + b3 * x3 + b4))), 6) as score from lx, k8""")
def _(spark, sf):
    scaled, model = fitted(spark, sf)
    return L.logistic_score(model, scaled).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("score", 6).alias("score"))


@query("mll08_save_model", FORMULA)
def _(spark, sf):
    _, model = fitted(spark, sf)
    path = scratch(spark, "model")
    L.save_model(spark, model, 0.5, path)
    return six(L.formula(spark, *L.load_model(spark, path)))


# ---- sources and sinks over the given tables -----------------------------------------

@query("snk01_write_read_pixels", "select r, c, prob as value from fx_pix")
def _(spark, sf):
    from netresil.sources.rasters import read_pixels, write_pixels
    path = scratch(spark, "pixels")
    write_pixels(pix(spark, sf, "prob").select(F.lit("city").alias("raster_id"), F.lit(1).alias("band"), "r", "c", "value"), path, tile=64)
    return read_pixels(spark, path, "city", [1]).select("r", "c", "value")


@query("src01_read_pixels", "select 2 as band, count(*) as n, cast(sum(green) as bigint) as total from fx_pix union all select 3, count(*), cast(sum(blue) as bigint) from fx_pix")
def _(spark, sf):
    from checks.rasters import bands
    from netresil.sources.rasters import read_pixels, write_pixels
    path = scratch(spark, "pixels")
    write_pixels(bands(spark, sf).withColumn("raster_id", F.lit("rgb")), path, tile=64)
    return read_pixels(spark, path, "rgb", [2, 3]).groupBy("band").agg(F.count("*").alias("n"), F.sum("value").cast("bigint").alias("total")).select(
        F.col("band").cast("int").alias("band"), "n", "total")


@query("snk02_src07_write_read_graph", "select src, dst, edge_key, length_m, highway, n.r as row from fx_multi join fx_nodes n on node_id = src")
def _(spark, sf):
    from netresil.sources.networks import read_graph, write_graph
    path = scratch(spark, "graph")
    write_graph(fx(spark, sf, "fx_nodes"), fx(spark, sf, "fx_multi"), path)
    n, e = read_graph(spark, path)
    return e.join(n.select(F.col("node_id").alias("src"), F.col("r").alias("row")), "src").select("src", "dst", "edge_key", "length_m", "highway", "row")


@query("src05_read_osm", f"""
, w as (select src, dst, row_number() over (partition by src order by dst) as k, highway from fx_edges where highway is not null)
select src, dst, highway from w""")
def _(spark, sf):
    from netresil.sources.networks import read_osm
    path = scratch(spark, "osm")
    q = lambda c: F.col(c).cast("string")
    nd = fx(spark, sf, "fx_nodes").select(F.concat(
        F.lit('<node id="'), q("node_id"), F.lit('" lat="'), (23 + F.col("r") / 1000.0).cast("string"), F.lit('" lon="'), (72 + F.col("c") / 1000.0).cast("string"), F.lit('"/>')).alias("value"))
    wy = fx(spark, sf, "fx_edges").select(F.concat(
        F.lit('<way id="'), q("src"), F.lit('"><nd ref="'), q("src"), F.lit('"/><nd ref="'), q("dst"), F.lit('"/>'),
        F.coalesce(F.concat(F.lit('<tag k="highway" v="'), F.col("highway"), F.lit('"/>')), F.lit("")), F.lit("<tag k=\"lanes\" v=\"2\"/></way>")).alias("value"))
    # one well-formed extract per 2,000 corners
    both = nd.unionByName(wy).withColumn("part", F.floor(F.regexp_extract("value", 'id="([0-9]+)"', 1).cast("bigint") / 2000))
    doc = both.groupBy("part").agg(F.concat(F.lit("<osm>"), F.array_join(F.collect_list("value"), "\n"), F.lit("</osm>")).alias("value"))
    doc.select("value").write.option("maxRecordsPerFile", 1).text(path)
    _, edges = read_osm(spark, path)
    return edges.select("src", "dst", X.first_class(F.col("highway")).alias("highway"))


@query("src06_read_geojson", "select src as feature_src, dst, 2 as points from fx_trails")
def _(spark, sf):
    from netresil.sources.networks import GEOJSON
    path = scratch(spark, "geojson")
    e = fx(spark, sf, "fx_trails")
    doc = e.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("LineString").alias("type"), F.array(F.array(F.col("src").cast("double"), F.lit(23.0)), F.array(F.col("dst").cast("double"), F.lit(23.5))).alias("coordinates")).alias("geometry"),
        F.create_map(F.lit("k"), F.lit("v")).alias("properties"))).alias("features"))).alias("value"))
    doc.write.text(path)
    # many one-line documents: the same schema and explodes, read line by line
    from netresil.sources.networks import geojson_vertices
    v = geojson_vertices(spark.read.schema(GEOJSON).json(path).withColumn("file", F.monotonically_increasing_id()))
    return v.groupBy("file", "feature").agg(
        F.max(F.when(F.col("seq") == 0, F.col("lon"))).cast("bigint").alias("feature_src"), F.max(F.when(F.col("seq") == 1, F.col("lon"))).cast("bigint").alias("dst"),
        F.count("*").cast("int").alias("points")).select("feature_src", "dst", "points")


@query("src08_read_history", "select epoch, round(val_iou, 8) as val_iou from fx_history")
def _(spark, sf):
    from netresil.sources.networks import read_history
    path = scratch(spark, "history")
    one = fx(spark, sf, "fx_history").agg(F.to_json(F.collect_list(F.struct("epoch", "val_iou"))).alias("value"))  # an epoch per row
    one.write.text(path)
    return read_history(spark, {"a": path, "missing": path + "-none"}).select("epoch", F.round("val_iou", 8).alias("val_iou"))


@query("src09_tile_catalog", "select distinct p_type as city from part")
def _(spark, sf):
    from netresil.sources.networks import tile_catalog
    path = scratch(spark, "tiles")
    fx(spark, sf, "fx_tiles").select("stem", "city").repartition("city").write.partitionBy("city").parquet(f"{path}/images")
    return tile_catalog(spark, path, "*.parquet", "images").select(F.regexp_extract("path", "city=([^/]+)/", 1).alias("city")).distinct()


@query("snk03_write_metrics", """
select 4.788e0 as before_density, 3.533e0 as after_density, count(*) as nodes, (select count(*) from fx_trails) as edges from fx_nodes""")
def _(spark, sf):
    from netresil.sources.networks import write_metrics
    path = scratch(spark, "metrics")
    one = lambda d, r: F.struct(F.lit(d).alias("density"), F.lit(r).alias("ratio"))
    n = fx(spark, sf, "fx_nodes").agg(F.count("*").alias("nodes"))
    e = fx(spark, sf, "fx_trails").agg(F.count("*").alias("edges"))
    before = n.select(one(4.7881, 0.0241).alias("m")).select("m.*")
    after = n.join(F.broadcast(e)).select(one(3.5329, 0.0309).alias("m"), "nodes", "edges").select("m.*", "nodes", "edges")
    write_metrics(RP.metrics_document(before, after, 10.0), path)
    return spark.read.json(path).select(
        F.col("before_heuristic.component_break_density").alias("before_density"), F.col("after_heuristic.component_break_density").alias("after_density"), "nodes", "edges")


@query("snk04_edges_to_geojson", f"""
, e as (select src, dst, {LADDER} as cong, length_m from fx_multi where edge_key = 0)
select src, dst, 'E-' || src || '-' || dst as id, length_m, case when cong >= 2 then 'MEDIUM' when cong >= 1.3e0 then 'LOW' else 'VERY LOW' end as criticality, cong as congestion from e""")
def _(spark, sf):
    e = fx(spark, sf, "fx_multi").withColumn("congestion_level", X.road_class_congestion(F.col("highway")))
    out = RP.edges_to_geojson(fx(spark, sf, "fx_nodes"), e)
    p = lambda k: F.get_json_object("feature", f"$.properties.{k}")
    return out.select("src", "dst", p("id").alias("id"), p("length_m").cast("double").alias("length_m"), p("criticality").alias("criticality"), p("congestion").cast("double").alias("congestion"))


@query("snk05_routes_to_geojson", """
, k as (select l_orderkey, count(*) as n from lineitem group by 1 having count(*) > 1)
select l_orderkey as query_id, kind, case kind when 'line' then 'LineString' else 'Point' end as geometry from k, (values ('line'), ('start'), ('end')) v(kind)""")
def _(spark, sf):
    p = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    r = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(p)), lambda s: F.array(72 + s["l_partkey"] / 10000, 23 + s["l_suppkey"] / 1000)).alias("route_coords"))
    return RP.routes_to_geojson(r).select("query_id", "kind", F.get_json_object("feature", "$.geometry.type").alias("geometry"))


@query("snk06_cache_features", "select label, count(*) as n from fx_scores group by label")
def _(spark, sf):
    from netresil.sources.rasters import cache_features
    path = scratch(spark, "features")
    for _i in range(2):
        got = cache_features(lambda: features(spark, sf), path, spark)
    return got.groupBy("label").agg(F.count("*").alias("n"))
