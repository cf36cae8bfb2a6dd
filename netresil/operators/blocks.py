"""Components after many local failures, worked out inside one block of the plane.

A block arrives in one task with its streets, the weights of its nodes and its
incidents. The incidents are halved again and again along their wider axis;
before each halving all streets that no incident of the half can reach are
contracted, so what is left shrinks with the area the incidents cover. Only the
few streets around an incident are looked at for that incident alone.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np


def labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest node of the component of each of ``n`` nodes."""
    low = np.arange(n)
    while True:
        a, b = low[u], low[v]
        apart = a != b
        if not apart.any():
            return low
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = low[low]
            if (up == low).all():
                break
            low = up


@dataclass
class Block:
    """Streets ``u, v`` (``row``: their place in the tables of the task), weights of the nodes, and the components closed off."""

    u: np.ndarray
    v: np.ndarray
    row: np.ndarray
    weight: np.ndarray
    closed: int
    closed_max: int

    def contracted(self, near: np.ndarray) -> Block:
        """The block with all streets but the ``near`` ones contracted; nodes without a street left are closed off."""
        low = labels(len(self.weight), self.u[~near], self.v[~near])
        u, v = low[self.u[near]], low[self.v[near]]
        apart = u != v
        weight = np.bincount(low, self.weight, len(low)).astype(np.int64)
        root, live = low == np.arange(len(low)), np.zeros(len(low), bool)
        live[u[apart]] = live[v[apart]] = True
        shut = root & ~live
        number = np.cumsum(live) - 1
        return Block(
            number[u[apart]], number[v[apart]], self.row[near][apart], weight[live],
            self.closed + int(shut.sum()), max(self.closed_max, int(weight[shut].max(initial=0))))

    def without(self, failed: np.ndarray) -> tuple[int, int]:
        """Number and greatest weight of the components once the ``failed`` streets are gone."""
        low = labels(len(self.weight), self.u[~failed], self.v[~failed])
        size = np.bincount(low, self.weight, len(low))
        return self.closed + int((low == np.arange(len(low))).sum()), max(self.closed_max, int(size.max(initial=0)))


def after_failures(block: Block, box: np.ndarray, zone: np.ndarray, failed_zone: np.ndarray, failed_row: np.ndarray) -> np.ndarray:
    """Components and greatest weight after each zone's failure, one row per zone.

    ``box``: x0, x1, y0, y1 of every street; ``zone``: x, y, radius; the failed
    streets come as pairs of a zone's and a street's place, ordered by zone.
    """
    out = np.zeros((len(zone), 2), np.int64)
    first = np.searchsorted(failed_zone, np.arange(len(zone) + 1))
    gone = np.zeros(len(box), bool)
    # zones of one size at a time: a huge one would keep all others' streets
    size = np.floor(np.log2(np.maximum(zone[:, 2], 1.0)) / 2)
    todo = [(block, np.flatnonzero(size == s)) for s in np.unique(size)]
    while todo:
        held, mine = todo.pop()
        x, y, r = zone[mine, 0], zone[mine, 1], zone[mine, 2].max()
        b = box[held.row]
        near = (b[:, 1] + r >= x.min()) & (b[:, 0] - r <= x.max()) & (b[:, 3] + r >= y.min()) & (b[:, 2] - r <= y.max())
        held = held.contracted(near)
        wide, high = np.ptp(x), np.ptp(y)
        if len(mine) > 1 and max(wide, high) > r:
            order = mine[np.argsort(x if wide >= high else y, kind="stable")]
            half = len(order) // 2
            todo += [(replace(held), order[:half]), (replace(held), order[half:])]
            continue
        for i in mine:
            rows = failed_row[first[i] : first[i + 1]]
            gone[rows] = True
            out[i] = held.without(gone[held.row])
            gone[rows] = False
    return out
