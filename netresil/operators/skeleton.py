"""From road masks to graphs: thinning, tracing, stubs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netresil.operators.components import star_labels
from netresil.operators.raster import AROUND, _offsets, neighbour_count, neighbours8
from netresil.session import Rounds, cut_lineage

# clockwise from north, the order in which the thinning rules read neighbours
RING = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
#: Side of a tile and width of the border it sees of its neighbours when thinning.
TILE, HALO = 256, 32


def thin(pixels: DataFrame, tile: int = TILE, halo: int = HALO) -> DataFrame:
    """Skeleton of width one by the parallel rules of Zhang and Suen (1984).

    The raster is thinned tile by tile, each with ``halo`` pixels of what lies
    around it. A pass reaches one pixel further in, so a tile takes
    ``halo // 2 - 1`` iterations of both passes before its own pixels could
    depend on anything unseen; then border pixels are exchanged. The result is
    that of thinning the raster as a whole. Roads of up to ``halo - 4`` pixels
    end in one round. Rows without place are left out, repeated ones are one.
    """
    if not 4 <= halo <= tile:
        raise ValueError("halo must be from 4 pixels to a tile's side")
    seen_by = lambda i: F.sequence(F.floor((i - halo) / F.lit(tile)), F.floor((i + halo) / F.lit(tile)))
    rounds = Rounds()
    cur = pixels.select(F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c")).dropna()
    while True:
        dealt = cur.select("r", "c", F.explode(seen_by(F.col("r"))).alias("tr")).select("r", "c", "tr", F.explode(seen_by(F.col("c"))).alias("tc"))
        done = dealt.groupBy("tr", "tc").applyInPandas(lambda key, df: _thin_tile(key, df, tile, halo), "r bigint, c bigint, moving boolean")
        done = rounds.cut(done)[0]
        cur = done.select("r", "c")
        if done.where("moving").isEmpty():
            return cur


def _thin_tile(key: tuple, df: pd.DataFrame, tile: int, halo: int) -> pd.DataFrame:
    """What is left of a tile's own pixels, and whether the last iteration still changed some that matter to them."""
    r0, c0 = (int(k) * tile - halo for k in key)
    side = tile + 2 * halo
    on = np.zeros((side, side), bool)
    on[df["r"].to_numpy() - r0, df["c"].to_numpy() - c0] = True
    near = slice(halo - 2, halo + tile + 2)
    moving = False
    for _ in range(halo // 2 - 1):
        before = on
        for first in (True, False):
            on = on & ~_removable(on, first)
        moving = bool((before[near, near] != on[near, near]).any())
        if (before == on).all():
            break
    r, c = np.nonzero(on[halo:halo + tile, halo:halo + tile])
    return pd.DataFrame({"r": r + r0 + halo, "c": c + c0 + halo, "moving": moving})


def _removable(on: np.ndarray, first: bool) -> np.ndarray:
    """Pixels that one pass takes away, all judged on the same picture."""
    h, w = on.shape
    wide = np.pad(on, 1)
    ring = [wide[1 + dr:1 + dr + h, 1 + dc:1 + dc + w] for dr, dc in RING]
    around = np.sum(ring, axis=0, dtype=np.int8)
    rises = np.sum([~a & b for a, b in zip(ring, ring[1:] + ring[:1])], axis=0, dtype=np.int8)
    n, e, s, w_ = ring[0], ring[2], ring[4], ring[6]
    free = ~(n & e & s) & ~(e & s & w_) if first else ~(n & e & w_) & ~(n & s & w_)
    return (around >= 2) & (around <= 6) & (rises == 1) & free


def trace_edges(skel: DataFrame, width: int, pixel_m: float, lone_pixels: bool = False,
                count_pixels: bool = True) -> tuple[DataFrame, DataFrame]:
    """Contract chains of skeleton pixels into edges between nodes.

    Nodes are endpoints and junctions, with id = row x width + col. A chain is
    a component of the remaining pixels, each of which has two neighbours, so
    it touches nodes exactly twice unless it is a closed ring. ``count_pixels``
    measures an edge by its pixels including both ends, otherwise by steps.
    Twin chains stay parallel edges; loops on one node are dropped.
    """
    skel = cut_lineage(skel.select("r", "c"))
    px = cut_lineage(neighbour_count(skel).withColumn("id", F.col("r") * width + F.col("c")))
    n = F.col("neighbours")
    is_node = (n == 1) | (n >= 3) | ((n == 0) if lone_pixels else F.lit(False))
    nodes = px.where(is_node).select(
        F.col("id").alias("node_id"), "r", "c",
        F.when(n == 1, "endpoint").when(n >= 3, "junction").otherwise("lone").alias("node_type"),
    )
    touch = neighbours8(skel).select(
        (F.col("r") * width + F.col("c")).alias("a"), (F.col("r2") * width + F.col("c2")).alias("b")
    )
    kind = px.select("id", is_node.alias("node"))
    touch = cut_lineage(
        touch.join(kind.select(F.col("id").alias("a"), F.col("node").alias("na")), "a")
        .join(kind.select(F.col("id").alias("b"), F.col("node").alias("nb")), "b")
    )
    straight = touch.where(F.col("na") & F.col("nb") & (F.col("a") < F.col("b"))).select(
        F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(0).cast("bigint").alias("inner"), F.lit(None).cast("bigint").alias("chain")
    )
    chain_px = px.where(~is_node & (n == 2)).select("id")
    labels = star_labels(touch.where(~F.col("na") & ~F.col("nb")).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    chain = cut_lineage(chain_px.join(labels, F.col("id") == F.col("node_id"), "left").select(
        "id", F.coalesce("component", "id").alias("chain")
    ))
    size = chain.groupBy("chain").agg(F.count(F.lit(1)).alias("inner"))
    ends = touch.where(~F.col("na") & F.col("nb")).select(F.col("a").alias("id"), F.col("b").alias("node")).join(chain, "id")
    ended = ends.groupBy("chain").agg(F.min("node").alias("src"), F.max("node").alias("dst"), F.count(F.lit(1)).alias("k"))
    long = ended.where(F.col("k") == 2).join(size, "chain").select("src", "dst", "inner", "chain")
    steps = F.col("inner") + (2 if count_pixels else 1)
    edges = straight.unionByName(long).where(F.col("src") != F.col("dst")).select(
        "src", "dst", (steps * F.lit(float(pixel_m))).alias("length_m"), F.lit("original").alias("edge_type"), "chain"
    )
    return nodes, edges


def simple_graph(edges: DataFrame) -> DataFrame:
    """One edge per pair, the shortest."""
    return edges.groupBy("src", "dst").agg(F.min("length_m").alias("length_m"), F.first("edge_type").alias("edge_type"))


def _step(walk: DataFrame, skel: DataFrame) -> DataFrame:
    """Move each walker to its first unvisited set neighbour in scan order."""
    told = walk.withColumn("o", _offsets(AROUND)).select(
        "id", (F.col("cr") + F.col("o.dr")).alias("r"), (F.col("cc") + F.col("o.dc")).alias("c"), F.col("o.i").alias("i"), "seen"
    ).where(~F.expr("array_contains(seen, struct(r, c))"))
    nxt = told.join(skel, ["r", "c"]).groupBy("id").agg(F.min(F.struct("i", "r", "c")).alias("m")).select(
        "id", F.col("m.r").alias("nr"), F.col("m.c").alias("nc")
    )
    moved = F.col("nr").isNotNull() & ~F.col("stuck")
    return walk.join(nxt, "id", "left").select(
        "id", "r", "c",
        F.when(moved, F.col("nr")).otherwise(F.col("cr")).alias("cr"),
        F.when(moved, F.col("nc")).otherwise(F.col("cc")).alias("cc"),
        F.when(moved, F.concat("seen", F.array(F.struct(F.col("nr").alias("r"), F.col("nc").alias("c"))))).otherwise(F.col("seen")).alias("seen"),
        (~moved).alias("stuck"),
    )


def walk_stubs(ends: DataFrame, skel: DataFrame, steps: int = 5) -> DataFrame:
    """Up to ``steps`` skeleton pixels walked from each end: ``id, r, c, cr, cc, seen``.

    Every step is written: it reads the one before twice, so a plan of all steps
    would hold the joins of each many times over in one task.
    """
    skel = cut_lineage(skel.select("r", "c"))
    tables = Rounds()
    (walk,) = tables.cut(ends.select(
        "id", "r", "c", F.col("r").alias("cr"), F.col("c").alias("cc"), F.array(F.struct("r", "c")).alias("seen"), F.lit(False).alias("stuck")
    ))
    for _ in range(steps):
        (walk,) = tables.cut(_step(walk, skel))
    return walk.drop("stuck")


def stub_vectors(ends: DataFrame, skel: DataFrame, steps: int = 5) -> DataFrame:
    """Unit vector pointing out of each dead end, null for a lone pixel: ``id, ur, uc``."""
    dr, dc = F.col("r") - F.col("cr"), F.col("c") - F.col("cc")
    n = F.sqrt((dr * dr + dc * dc).cast("double"))
    return walk_stubs(ends, skel, steps).select(
        "id", F.when(n > 1e-6, dr / n).alias("ur"), F.when(n > 1e-6, dc / n).alias("uc")
    )


def pixel_paths(ends: DataFrame, skel: DataFrame, first: int = 5) -> DataFrame:
    """The first pixels of the chain leaving each end."""
    return walk_stubs(ends, skel, first - 1).select("id", F.col("seen").alias("pixel_path"))


def bounded_reach(pairs: DataFrame, skel: DataFrame, id_: str = "pair") -> DataFrame:
    """Whether two pixels are joined through the skeleton within ``limit`` steps.

    ``pairs(pair, r1, c1, r2, c2, limit)`` -> ``(pair, joined)``. The frontier
    of a pair stops at its target, its limit, or where the straight distance
    left exceeds the steps left.
    """
    pairs = cut_lineage(pairs.select(id_, "r1", "c1", "r2", "c2", "limit"))
    skel = cut_lineage(skel.select("r", "c"))
    goal = pairs.select(id_, "r2", "c2", "limit")
    front = pairs.select(id_, F.col("r1").alias("r"), F.col("c1").alias("c"))
    seen = front
    found = pairs.where((F.col("r1") == F.col("r2")) & (F.col("c1") == F.col("c2"))).select(id_)
    step = 0
    while True:
        step += 1
        left = F.greatest(F.abs(F.col("r2") - F.col("r")), F.abs(F.col("c2") - F.col("c")))
        nxt = (
            front.withColumn("o", _offsets(AROUND))
            .select(id_, (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"))
            .distinct()
            .join(skel, ["r", "c"])
            .join(seen, [id_, "r", "c"], "left_anti")
            .join(goal, id_)
            .where(left + step <= F.col("limit"))
        )
        nxt = cut_lineage(nxt.select(id_, "r", "c", (left == 0).alias("hit")))
        hits = nxt.where("hit").select(id_).distinct()
        found = found.unionByName(hits)
        if nxt.limit(1).count() == 0:
            break
        front = nxt.join(hits, id_, "left_anti").select(id_, "r", "c")
        seen = seen.unionByName(nxt.select(id_, "r", "c"))
        if step % 8 == 0:
            seen, found, front = cut_lineage(seen), cut_lineage(found), cut_lineage(front)
    return pairs.select(id_).join(found.distinct().withColumn("j", F.lit(True)), id_, "left").select(
        id_, F.coalesce("j", F.lit(False)).alias("joined")
    )


def corridor_coverage(lines: DataFrame, mask: DataFrame, shape: tuple[int, int], line_id: str = "pair", n: int = 3) -> DataFrame:
    """Share of set pixels among those within n steps of each pixel line.

    ``mask`` holds the set pixels ``r, c``.
    """
    from netresil.functions.geometry import pixel_line
    from netresil.operators.raster import dilate, in_bounds

    px = pixel_line(lines.select(line_id, "r1", "c1", "r2", "c2")).select(line_id, "r", "c")
    wide = in_bounds(dilate(in_bounds(px, shape), n, [line_id]), shape)
    hit = mask.select("r", "c").withColumn("hit", F.lit(1))
    return wide.join(hit, ["r", "c"], "left").groupBy(line_id).agg(
        F.count(F.lit(1)).alias("pixels"), F.avg(F.coalesce("hit", F.lit(0))).alias("coverage")
    )
