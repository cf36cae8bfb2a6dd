"""Betweenness from pivots on a network that one task can hold.

Every task gets every street once and some of the pivots,
and works out distances, path counts and dependencies of a few pivots at a time
in arrays (Brandes 2001). It returns one sum per node, so nothing is kept per
pivot and node; what is sent is the network once per task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pivots of a task (an expected number) and tasks at most, each of which gets the streets; nodes times pivots worked on at once.
TASK_PIVOTS, MOST_TASKS, AT_ONCE = 16, 1024, 1 << 21


def dependencies(pivots: DataFrame, adj: DataFrame, count: int, tie: float) -> DataFrame:
    """``node_id, b``: what the paths from all other pivots depend on each node, summed.

    ``pivots(query_id)``, some ``count`` of them; ``adj`` both directions of
    every street (see ``routing.adjacency``); costs that differ by a share of
    ``tie`` are equal.
    """
    parts = min(max(1, -(-count // TASK_PIVOTS)), MOST_TASKS)
    streets = adj.where(F.col("u") < F.col("v")).select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(True).alias("street"), "u", "v", "w")
    asked = pivots.where(F.col("query_id").isNotNull()).select(
        F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"), F.lit(False).alias("street"),
        F.col("query_id").alias("u"), F.lit(0).cast("bigint").alias("v"), F.lit(0.0).alias("w"))
    # by ranges: hashes would deal several parts to one task
    rows = streets.unionByName(asked).repartitionByRange(parts, "part")
    told = rows.groupBy("part").applyInPandas(lambda table: _summed(table, tie), "node_id bigint, b double")
    return told.groupBy("node_id").agg(F.sum("b").alias("b"))


def _summed(table: pd.DataFrame, tie: float) -> pd.DataFrame:
    street = table["street"].to_numpy(bool)
    asked = np.unique(table["u"].to_numpy(np.int64)[~street])
    a, b, w = (table[c].to_numpy(kind)[street] for c, kind in (("u", np.int64), ("v", np.int64), ("w", float)))
    ids = np.unique(np.concatenate([a, b]))
    asked = asked[np.isin(asked, ids)]
    if not len(asked):
        return pd.DataFrame({"node_id": ids[:0], "b": w[:0]})
    a, b = np.searchsorted(ids, a), np.searchsorted(ids, b)
    u, v, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
    order = np.argsort(u, kind="stable")
    ways = _Ways(len(ids), u[order], v[order], w[order])
    some = max(1, AT_ONCE // len(ids))
    total = np.zeros(len(ids))
    for i in range(0, len(asked), some):
        total += ways.dependencies(np.searchsorted(ids, asked[i : i + some]), tie)
    held = np.flatnonzero(total)
    return pd.DataFrame({"node_id": ids[held], "b": total[held]})


def _places(start: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all entries of the rows ``at``, and how many each has."""
    many = start[at + 1] - start[at]
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start[at], many), many


class _Ways:
    """Directed streets between ``n`` nodes, ordered by their tails."""

    def __init__(self, n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray):
        self.n, self.u, self.v, self.w = n, u, v, w
        self.start = np.searchsorted(u, np.arange(n + 1))

    def distances(self, pivot: np.ndarray) -> np.ndarray:
        """Least cost from every pivot to every node, one row of ``n`` per pivot."""
        best = np.full(len(pivot) * self.n, np.inf)
        stamp = np.empty(len(best), np.int64)
        front = np.arange(len(pivot)) * self.n + pivot
        best[front] = 0.0
        while len(front):
            node = front % self.n
            k, many = _places(self.start, node)
            cost = np.repeat(best[front], many) + self.w[k]
            to = np.repeat(front - node, many) + self.v[k]
            better = cost < best[to]
            to = to[better]
            np.minimum.at(best, to, cost[better])
            front = _once(to, stamp)
        return best

    def dependencies(self, pivot: np.ndarray, tie: float) -> np.ndarray:
        """Sum over the pivots of the share of shortest paths through each node, the pivots' own left out."""
        n = self.n
        best = self.distances(pivot)
        tail, head = [], []
        for i in range(len(pivot)):
            d = best[i * n : (i + 1) * n]
            du, dv = d[self.u], d[self.v]
            with np.errstate(invalid="ignore"):
                k = np.flatnonzero((self.w > 0) & np.isfinite(du) & (np.abs(du + self.w - dv) <= tie * (1 + dv)))
            tail.append(self.u[k] + i * n)
            head.append(self.v[k] + i * n)
        tail, head = np.concatenate(tail), np.concatenate(head)
        size = len(best)
        start = np.concatenate(([0], np.cumsum(np.bincount(tail, minlength=size))))
        waits = np.bincount(head, minlength=size)
        paths, stamp = np.zeros(size), np.empty(size, np.int64)
        source = np.arange(len(pivot)) * n + pivot
        paths[source] = 1.0
        # a node is passed once all before it are; ones met by streets without length only have no paths
        front, passed = np.flatnonzero((waits == 0) & np.isfinite(best)), []
        while len(front):
            k, many = _places(start, front)
            to = head[k]
            np.add.at(paths, to, np.repeat(paths[front], many))
            np.subtract.at(waits, to, 1)
            passed.append(k)
            front = _once(to[waits[to] == 0], stamp)
        rests = np.zeros(size)
        for k in reversed(passed):
            k = k[paths[tail[k]] > 0]
            np.add.at(rests, tail[k], paths[tail[k]] / paths[head[k]] * (1 + rests[head[k]]))
        rests[source] = 0.0
        return rests.reshape(len(pivot), n).sum(axis=0)


def _once(places: np.ndarray, stamp: np.ndarray) -> np.ndarray:
    """Each of the places once; ``stamp`` is room to write on."""
    turn = np.arange(len(places))
    stamp[places] = turn
    return places[stamp[places] == turn]
