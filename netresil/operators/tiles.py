"""Searches and sums over a whole network, tile by tile of the plane.

Nodes are dealt to tiles of at most ``TILE_NODES``. A task holds the streets of
one tile and a few queries, works inside the tile until nothing changes, and
sends on only what crosses into other tiles. So rounds follow the number of
tiles a way crosses, not its streets; a query's tile that nothing new reaches is
not met again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netresil.session import Rounds, cut_lineage

#: Nodes of a tile (each halved in both directions until it holds no more), and queries of a task, an expected number.
TILE_NODES, TASK_QUERIES = 4096, 16
#: Width of a tile in metres below which its nodes are dealt by hash.
LEAST_TILE = 1e-3


def tiles(adj: DataFrame) -> DataFrame:
    """``node, tile`` of every node with a street; ``adj`` as from ``routing.adjacency``."""
    at = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    left = cut_lineage(adj.select(F.col("u").alias("node"), at("ux").alias("x"), at("uy").alias("y")).dropDuplicates(["node"]))
    low_x, low_y, high_x, high_y = left.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    side = max((high_x or 0.0) - (low_x or 0.0), (high_y or 0.0) - (low_y or 0.0), 1.0) * 1.0001
    dealt = None
    while True:
        cell = [F.floor((F.col(c) - F.lit(low or 0.0)) / F.lit(side)).cast("bigint") for c, low in (("x", low_x), ("y", low_y))]
        part = F.lit(0).cast("bigint")
        if side < LEAST_TILE:
            part = F.pmod(F.xxhash64("node"), F.ceil(F.lit(left.count() / TILE_NODES)))
        placed = left.withColumn("tile", F.xxhash64(F.lit(side), *cell, part))
        full = placed.groupBy("tile").count().where(F.col("count") > (TILE_NODES if side >= LEAST_TILE else 1 << 62)).select("tile")
        full = cut_lineage(full)
        fits = placed.join(full, "tile", "left_anti").select("node", "tile")
        dealt = fits if dealt is None else dealt.unionByName(fits)
        if full.isEmpty():
            return cut_lineage(dealt)
        left = cut_lineage(placed.join(full, "tile", "left_semi").drop("tile"))
        side /= 2


def place_streets(adj: DataFrame, tile: DataFrame) -> DataFrame:
    """``u, v, w, tile, far``: every direction with the tiles of both ends."""
    a = tile.select(F.col("node").alias("u"), "tile")
    b = tile.select(F.col("node").alias("v"), F.col("tile").alias("far"))
    return cut_lineage(adj.select("u", "v", "w").join(a, "u").join(b, "v"))


def _part(parts: int):
    return F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part")


def distances(od: DataFrame, streets: DataFrame, tile: DataFrame, queries: int) -> DataFrame:
    """``query_id, node, tile, dist`` of every node reachable from a query's ``src`` over ``streets`` (ids are bigints)."""
    parts = max(1, -(-queries // TASK_QUERIES))
    known = cut_lineage(
        od.select("query_id", F.col("src").alias("node"), F.lit(0.0).alias("dist")).join(tile, "node").select("tile", "query_id", "node", "dist"))
    fresh, tables = known, Rounds()
    out = "tile bigint, query_id bigint, node bigint, dist double"
    while True:
        touched = fresh.select("tile", "query_id").distinct()
        sent = _in_tiles(known.join(touched, ["tile", "query_id"], "left_semi"), streets, parts, _crossing, out)
        offers = sent.groupBy("tile", "query_id", "node").agg(F.min("dist").alias("offer"))
        # one table a round: what is known, and whether this round bettered it
        both = known.join(offers, ["tile", "query_id", "node"], "full").select(
            "tile", "query_id", "node", F.least("dist", "offer").alias("dist"),
            (F.col("offer").isNotNull() & (F.col("dist").isNull() | (F.col("offer") < F.col("dist")))).alias("better"))
        (both,) = tables.cut(both)
        known, fresh = both.drop("better"), both.where("better")
        if fresh.isEmpty():
            return cut_lineage(_in_tiles(known, streets, parts, _inside, out))


def _in_tiles(entries: DataFrame, streets: DataFrame, parts: int, work, schema: str) -> DataFrame:
    dealt = entries.withColumn("part", _part(parts))
    copies = streets.join(dealt.select("tile", "part").distinct(), "tile")
    zero = F.lit(0).cast("bigint")
    rows = copies.select("tile", "part", F.lit(True).alias("street"), F.col("u").alias("a"), F.col("v").alias("b"), F.col("w").alias("x"), "far").unionByName(
        dealt.select("tile", "part", F.lit(False).alias("street"), F.col("query_id").alias("a"), F.col("node").alias("b"), F.col("dist").alias("x"), zero.alias("far")))
    return rows.groupBy("tile", "part").applyInPandas(work, schema)


def _settled(table: pd.DataFrame):
    """Nodes and queries of the task, the streets, and the least cost of every query at every node of the tile."""
    flag = table["street"].to_numpy(bool)
    street, entry = table[flag], table[~flag]
    here = int(table["tile"].iloc[0])
    ids = np.unique(np.concatenate([street["a"].to_numpy(np.int64), entry["b"].to_numpy(np.int64)]))
    asked = np.unique(entry["a"].to_numpy(np.int64))
    stays = street["far"].to_numpy(np.int64) == here
    own = street[stays]
    u, v = (np.searchsorted(ids, own[c].to_numpy(np.int64)) for c in "ab")
    order = np.argsort(u, kind="stable")
    v, w = v[order], own["x"].to_numpy(float)[order]
    first = np.searchsorted(u[order], np.arange(len(ids) + 1))
    n = len(ids)
    best = np.full(len(asked) * n, np.inf)
    at = np.searchsorted(asked, entry["a"].to_numpy(np.int64)) * n + np.searchsorted(ids, entry["b"].to_numpy(np.int64))
    np.minimum.at(best, at, entry["x"].to_numpy(float))
    front = np.unique(at)
    while len(front):
        node = front % n
        many = first[node + 1] - first[node]
        edge = np.repeat(first[node] - np.cumsum(many) + many, many) + np.arange(many.sum())
        cost = np.repeat(best[front], many) + w[edge]
        to = np.repeat(front - node, many) + v[edge]
        better = cost < best[to]
        to, cost = to[better], cost[better]
        np.minimum.at(best, to, cost)
        front = np.unique(to)
    return ids, asked, street[~stays], best.reshape(len(asked), n)


def _crossing(table: pd.DataFrame) -> pd.DataFrame:
    ids, asked, street, best = _settled(table)
    cost = best[:, np.searchsorted(ids, street["a"].to_numpy(np.int64))] + street["x"].to_numpy(float)
    q, k = np.nonzero(np.isfinite(cost))
    return pd.DataFrame({"tile": street["far"].to_numpy(np.int64)[k], "query_id": asked[q], "node": street["b"].to_numpy(np.int64)[k], "dist": cost[q, k]})


def _inside(table: pd.DataFrame) -> pd.DataFrame:
    ids, asked, _, best = _settled(table)
    q, k = np.nonzero(np.isfinite(best))
    return pd.DataFrame({"tile": np.full(len(q), int(table["tile"].iloc[0])), "query_id": asked[q], "node": ids[k], "dist": best[q, k]})


def push(dag: DataFrame, start: DataFrame, queries: int) -> DataFrame:
    """``query_id, node, tile, val``: start values plus all that is sent along ``dag``.

    ``dag(query_id, tail, head, tile, far, share)`` sends a share of the tail's
    whole value to the head; it has no circles. ``start(query_id, node, tile,
    val)``. Values are sums, so what reaches a tile later is sent on by itself.
    """
    parts = max(1, -(-queries // TASK_QUERIES))
    out = "tile bigint, query_id bigint, node bigint, val double, crossed boolean"
    fresh, done, rounds = start, None, 0
    while True:
        touched = fresh.select("tile", "query_id").distinct()
        zero = F.lit(0).cast("bigint")
        rows = dag.join(touched, ["tile", "query_id"], "left_semi").select(
            "tile", _part(parts), "query_id", F.col("tail").alias("a"), F.col("head").alias("b"), "far", F.col("share").alias("x"), F.lit(True).alias("street"))
        rows = rows.unionByName(fresh.select(
            "tile", _part(parts), "query_id", F.col("node").alias("a"), zero.alias("b"), zero.alias("far"), F.col("val").alias("x"), F.lit(False).alias("street")))
        told = cut_lineage(rows.groupBy("tile", "part").applyInPandas(_sums, out))
        own = told.where(~F.col("crossed")).drop("crossed")
        done = own if done is None else done.unionByName(own)
        rounds += 1
        if rounds % 16 == 0:
            done = cut_lineage(done)
        fresh = told.where("crossed").drop("crossed")
        if fresh.isEmpty():
            return cut_lineage(done.groupBy("query_id", "node", "tile").agg(F.sum("val").alias("val")))


def _sums(table: pd.DataFrame) -> pd.DataFrame:
    flag = table["street"].to_numpy(bool)
    edge, entry = table[flag], table[~flag]
    here = int(table["tile"].iloc[0])
    stays = edge["far"].to_numpy(np.int64) == here
    pair = lambda t, c: np.stack([t["query_id"].to_numpy(np.int64), t[c].to_numpy(np.int64)])
    ends = np.concatenate([pair(edge, "a"), pair(edge[stays], "b"), pair(entry, "a")], axis=1)
    order = np.lexsort((ends[1], ends[0]))
    kept = ends[:, order]
    head = np.concatenate(([True], (kept[:, 1:] != kept[:, :-1]).any(axis=0)))
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(head) - 1
    kept, n = kept[:, head], int(head.sum())
    tail, to, first = np.split(number, [len(edge), len(edge) + int(stays.sum())])
    share = edge["x"].to_numpy(float)
    inner, weight = tail[stays], share[stays]
    order = np.argsort(inner, kind="stable")
    to, weight = to[order], weight[order]
    start = np.searchsorted(inner[order], np.arange(n + 1))
    now = np.bincount(first, entry["x"].to_numpy(float), n)
    total = now.copy()
    front = np.flatnonzero(now)
    while len(front):
        many = start[front + 1] - start[front]
        k = np.repeat(start[front] - np.cumsum(many) + many, many) + np.arange(many.sum())
        at, back = np.unique(to[k], return_inverse=True)
        add = np.bincount(back, np.repeat(now[front], many) * weight[k], len(at))
        now[front] = 0.0
        now[at] = add
        total[at] += add
        front = at
    some = np.flatnonzero(total)
    over = np.flatnonzero(~stays & (total[tail] != 0))
    return pd.DataFrame({
        "tile": np.concatenate([np.full(len(some), here), edge["far"].to_numpy(np.int64)[over]]),
        "query_id": np.concatenate([kept[0, some], edge["query_id"].to_numpy(np.int64)[over]]),
        "node": np.concatenate([kept[1, some], edge["b"].to_numpy(np.int64)[over]]),
        "val": np.concatenate([total[some], total[tail[over]] * share[over]]),
        "crossed": np.concatenate([np.zeros(len(some), bool), np.ones(len(over), bool)]),
    })
