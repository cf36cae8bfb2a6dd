"""Relations derived from the given tables, in SQL both engines run as it is.

Every relation reads whole tables and grows with them: an order is a street
corner and, on the raster side, a pixel; a line item is a street segment to
the right, lower or lower-right corner; a customer is an incident and an
address; a supplier is a trip. Corners stand 100 m apart on a lattice whose
side is the square root of the number of orders, so density does not depend
on the scale factor.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

FX: dict[str, str] = {
    "fx_dim": """
select count(*) as n, cast(floor(sqrt(count(*))) as bigint) as side from {orders}""",

    "fx_nodes": """
select o_orderkey as node_id,
  cast(floor(o_orderkey / (select side from fx_dim)) as bigint) as r,
  o_orderkey % (select side from fx_dim) as c,
  cast(250000 + (o_orderkey % (select side from fx_dim)) * 100 + (o_orderkey * 7919) % 61 - 30 as double) as x,
  cast(2540000 + floor(o_orderkey / (select side from fx_dim)) * 100 + (o_orderkey * 104729) % 61 - 30 as double) as y
from {orders}""",

    # street segments, several per pair of corners where line items repeat
    "fx_seg": """
select l_orderkey as src,
  case l_partkey % 3 when 0 then l_orderkey + 1
    when 1 then l_orderkey + (select side from fx_dim)
    else l_orderkey + (select side from fx_dim) + 1 end as dst,
  l_quantity, l_linenumber, l_suppkey, l_partkey
from {lineitem}
where (l_partkey % 3 = 1 or l_orderkey % (select side from fx_dim) < (select side from fx_dim) - 1)""",

    "fx_multi": """
select s.src, s.dst,
  cast(row_number() over (partition by s.src, s.dst
    order by l_quantity, l_linenumber, l_suppkey, l_partkey) - 1 as int) as edge_key,
  cast(floor(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) * (1e2 + l_quantity) / 1e2) + 1 as double) as length_m,
  case o_orderpriority when '1-URGENT' then 'motorway' when '2-HIGH' then 'primary'
    when '3-MEDIUM' then 'secondary' when '5-LOW' then 'residential' else null end as highway
from fx_seg s join fx_nodes a on a.node_id = s.src join fx_nodes b on b.node_id = s.dst
join {orders} o on o.o_orderkey = s.src""",

    # one row per pair of corners: the shortest of its parallel segments
    "fx_edges": """
select src, dst, length_m, highway from fx_multi where edge_key = 0""",

    # one segment per corner: a fragmented network, as traced from rasters
    "fx_trails": """
select s.src, s.dst,
  cast(floor(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) + 1 as double) as length_m
from (select o_orderkey as src,
        case o_custkey % 2 when 0 then o_orderkey + 1 else o_orderkey + (select side from fx_dim) end as dst
      from {orders}
      where o_custkey % 2 = 1 or o_orderkey % (select side from fx_dim) < (select side from fx_dim) - 1) s
join fx_nodes a on a.node_id = s.src join fx_nodes b on b.node_id = s.dst""",

    "fx_incidents": """
select c_custkey as incident_id,
  cast(250000 + ((c_custkey * 6151) % (select n from fx_dim) % (select side from fx_dim)) * 100 + 17 as double) as x,
  cast(2540000 + floor((c_custkey * 6151) % (select n from fx_dim) / (select side from fx_dim)) * 100 + 23 as double) as y,
  cast(150 + ((c_custkey * 37) % 8) * 50 as double) as radius_m
from {customer}""",

    # addresses, a few of them off the network
    "fx_points": """
select c_custkey as point_id,
  cast(249000 + (c_custkey * 44029) % ((select side from fx_dim) * 100 + 2000) as double) as x,
  cast(2539000 + (c_custkey * 81017) % ((select side from fx_dim) * 100 + 2000) as double) as y
from {customer}""",

    # trips of up to nine blocks along each axis
    "fx_od": """
select od_id, src,
  (case when r >= dr then r - dr else r + dr end) * side + (case when c >= dc then c - dc else c + dc end) as dst
from (select s_suppkey as od_id, (s_suppkey * 7919) % (select n from fx_dim) as src, (select side from fx_dim) as side,
        cast(floor((s_suppkey * 7919) % (select n from fx_dim) / (select side from fx_dim)) as bigint) as r,
        (s_suppkey * 7919) % (select n from fx_dim) % (select side from fx_dim) as c,
        3 + s_suppkey % 7 as dr, 2 + (s_suppkey * 13) % 5 as dc
      from {supplier}) t""",

    # raster bands over the lattice, one pixel per order
    "fx_item": """
select l_orderkey, sum(l_quantity) as qty, count(*) as items,
  cast(sum(cast(round(l_discount * 100) as bigint)) as bigint) as disc
from {lineitem} group by l_orderkey""",

    "fx_pix": """
select n.r, n.c, coalesce(i.qty, -99999e0) as pop,
  coalesce(i.disc / (1e1 * i.items), 0e0) as prob,
  case o.o_orderstatus when 'F' then 0e0 else floor(o.o_totalprice) / 1e6 end as vv,
  floor(o.o_totalprice / 7e0) / 1e6 as vh,
  cast(floor(o.o_totalprice) as bigint) % 4096 as red,
  o.o_custkey % 3001 as green,
  coalesce(cast(i.qty as bigint), 0) as blue, i.disc, i.items
from {orders} o join fx_nodes n on n.node_id = o.o_orderkey
left join fx_item i on i.l_orderkey = o.o_orderkey""",

    # blocks of 4 x 4 pixels whose mean probability is low carry no road
    "fx_open": """
select cast(floor(r / 4e0) as bigint) as br, cast(floor(c / 4e0) as bigint) as bc, sum(disc) / (1e1 * sum(items)) as p
from fx_pix group by 1, 2""",

    # streets three pixels wide, twelve apart, with gaps
    "fx_mask": """
select x.r, x.c,
  cast(case when (x.r % 12 between 5 and 7 or x.c % 12 between 5 and 7) and o.p >= 0.46e0 then 1 else 0 end as int) as mask
from fx_pix x join fx_open o on o.br = cast(floor(x.r / 4e0) as bigint) and o.bc = cast(floor(x.c / 4e0) as bigint)""",

    # their centre lines: a skeleton of width one
    "fx_skel": """
select x.r, x.c
from fx_pix x join fx_open o on o.br = cast(floor(x.r / 4e0) as bigint) and o.bc = cast(floor(x.c / 4e0) as bigint)
where (x.r % 12 = 6 or x.c % 12 = 6) and o.p >= 0.46e0""",

    "fx_scores": """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount * 10 as score,
  case when l_returnflag = 'R' then 1 else 0 end as label
from {lineitem}""",

    "fx_history": """
select cast(row_number() over (order by d) as int) as epoch, n, val_iou, train_iou, val_loss
from (select date_trunc('day', ts) as d, count(*) as n,
        sum(case when event_type in ('click', 'view') then 1 else 0 end) / (1e0 * count(*)) as val_iou,
        sum(case when event_type = 'click' then 1 else 0 end) / (1e0 * count(*)) as train_iou,
        sum(case when event_type = 'error' then 1 else 0 end) / (1e0 * count(*)) as val_loss
      from {events} group by date_trunc('day', ts)) h""",

    "fx_tiles": """
select p_partkey, p_type as city, concat('AOI_', replace(p_brand, '#', ''), '_PS-RGB_img', cast(p_partkey as varchar(20))) as stem,
  p_partkey % 10 <> 0 as has_mask, p_partkey % 7 <> 0 as has_sar
from {part}""",
}


def _needs(name: str, seen: list[str]) -> None:
    for dep in re.findall(r"\bfx_\w+", FX[name]):
        if dep != name and dep not in seen:
            _needs(dep, seen)
    if name not in seen:
        seen.append(name)


def _chain(names: list[str], table) -> str:
    seen: list[str] = []
    for name in names:
        _needs(name, seen)
    return ",\n".join(f"{n} as ({FX[n].format(**{b: table(b) for b in BASE})})" for n in seen)


def fx(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The relation as a DataFrame over the parquet files of ``sf_dir``."""
    chain = _chain([name], lambda b: f"parquet.`{sf_dir}/{b}.parquet`")
    return spark.sql(f"with {chain}\nselect * from {name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _exact_rounding(sql: str) -> str:
    """``round_even(x, n)`` as the digits of the double itself.

    DuckDB's own multiplies first and rounds the rounded product, which turns
    60.045 into an exact half; ``format`` decides on the double, as the service
    these queries re-create does.
    """
    while (at := sql.rfind("round_even(")) >= 0:
        i = start = at + len("round_even(")
        depth, comma = 1, None
        while depth:
            c = sql[i]
            depth += (c == "(") - (c == ")")
            comma = i if c == "," and depth == 1 else comma
            i += 1
        x, n = sql[start:comma], sql[comma + 1 : i - 1].strip()
        sql = f"{sql[:at]}(cast(format('{{:.{n}f}}', cast({x} as double)) as double) + 0e0){sql[i:]}"
    return sql


def with_fx(body: str, recursive: bool = False) -> str:
    """Oracle SQL: the relations ``body`` mentions, put in front of it.

    ``body`` is a select, or further common table expressions followed by a
    select when it starts with ``, name as (``.
    """
    names = [n for n in dict.fromkeys(re.findall(r"\bfx_\w+", body)) if n in FX]
    head = "with recursive " if recursive else "with "
    chain = _chain(names, lambda b: b) if names else ""
    body = _exact_rounding(body.strip())
    if body.startswith(","):
        return f"{head}{chain}{body}" if chain else f"{head}{body[1:]}"
    return f"{head}{chain}\n{body}" if chain else body
