"""Components of graphs that lie in the plane, square by square.

Each square's streets are labelled in one task; only the nodes at which squares
meet are joined by rounds, so these see the seams instead of the network.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netresil.operators.blocks import labels
from netresil.operators.components import star_labels
from netresil.session import cut_lineage

#: Streets of one task, of which two ids each are held; a square is halved in both directions until it has no more, down to this side in metres.
LABEL_EDGES, LEAST_SQUARE = 1 << 20, 1e-3


def task_labels(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``star_labels`` of many graphs; those that fit a task are labelled in one."""
    keys = list(keys)
    edges = cut_lineage(edges)
    if not keys:
        return _in_one_task(edges, keys) if edges.count() <= LABEL_EDGES else star_labels(edges)
    crowded = cut_lineage(edges.groupBy(*keys).count().where(F.col("count") > LABEL_EDGES).drop("count"))
    light = _in_one_task(edges.join(crowded, keys, "left_anti"), keys)
    if crowded.isEmpty():
        return cut_lineage(light)
    return cut_lineage(light.unionByName(star_labels(edges.join(crowded, keys, "left_semi"), keys)))


def plane_labels(streets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, node_id, component`` of every node with a street, whole numbers as keys.

    ``streets(*keys, src, dst, x, y)``: the place tells the square a street is
    dealt to, any place is right. Graphs of at most ``LABEL_EDGES`` streets are
    one square each.
    """
    keys = list(keys)
    spot = ["_level", "_i", "_j"]
    at = lambda c: F.when(F.abs(F.col(c)) < 1e15, F.col(c).cast("double")).otherwise(0.0).alias(c)
    left = cut_lineage(streets.select(*keys, "src", "dst", at("x"), at("y")).where(F.col("src").isNotNull() & F.col("dst").isNotNull()))
    low_x, low_y, high_x, high_y, many = left.groupBy(*keys).agg(
        F.min("x").alias("a"), F.min("y").alias("b"), F.max("x").alias("c"), F.max("y").alias("d"), F.count(F.lit(1)).alias("n")).agg(
        F.min("a"), F.min("b"), F.max("c"), F.max("d"), F.max("n")).first()
    if (many or 0) <= LABEL_EDGES:
        return task_labels(left, keys)
    # begin where half of what a task takes would be in a square, were the largest graph spread evenly
    level = math.ceil(math.log(2 * many / LABEL_EDGES, 4))
    side, dealt = max(high_x - low_x, high_y - low_y, 1.0) * 1.0001 / 2**level, None
    while True:
        cell = [F.floor((F.col(c) - F.lit(low)) / F.lit(side)).cast("bigint").alias(s) for c, low, s in (("x", low_x, "_i"), ("y", low_y, "_j"))]
        placed = left.select(*keys, "src", "dst", "x", "y", F.lit(level).cast("bigint").alias("_level"), *cell)
        full = placed.groupBy(*keys, *spot).count().where(F.col("count") > LABEL_EDGES).drop("count")
        full = cut_lineage(full.limit(0) if side < LEAST_SQUARE else full)
        fits = placed.join(full, [*keys, *spot], "left_anti")
        dealt = fits if dealt is None else dealt.unionByName(fits)
        if full.isEmpty():
            break
        left = cut_lineage(placed.join(full, [*keys, *spot], "left_semi").select(*keys, "src", "dst", "x", "y"))
        side, level = side / 2, level + 1
    found = task_labels(dealt.select(*keys, *spot, "src", "dst"), [*keys, *spot]).drop(*spot)
    # nodes of several squares tie their labels together; a label is a node's id as well, the smallest of its square
    seam = found.groupBy(*keys, "node_id").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("component"), F.max("component").alias("other"))
    seam = cut_lineage(seam)
    ties = found.join(seam.where(F.col("component") != F.col("other")).select(*keys, "node_id", F.col("component").alias("one")), [*keys, "node_id"])
    root = star_labels(ties.select(*keys, F.col("one").alias("src"), F.col("component").alias("dst")), keys)
    root = root.select(*keys, F.col("node_id").alias("component"), F.col("component").alias("root"))
    return cut_lineage(seam.select(*keys, "node_id", "component").join(root, [*keys, "component"], "left").select(
        *keys, "node_id", F.coalesce("root", "component").alias("component")))


def _in_one_task(edges: DataFrame, keys: list[str]) -> DataFrame:
    schema = ", ".join(f"{k} bigint" for k in [*keys, "node_id", "component"])
    alone = edges.select(*keys, "src", "dst", F.lit(0).alias("_alone"))
    return alone.groupBy(*(keys or ["_alone"])).applyInPandas(lambda k, t: _labelled(keys, k, t), schema)


def _labelled(keys: list[str], values: tuple, table: pd.DataFrame) -> pd.DataFrame:
    u, v = table["src"].to_numpy(np.int64), table["dst"].to_numpy(np.int64)
    ids = np.unique(np.concatenate([u, v]))
    low = labels(len(ids), np.searchsorted(ids, u), np.searchsorted(ids, v))
    return pd.DataFrame({k: np.full(len(ids), x, np.int64) for k, x in zip(keys, values)} | {"node_id": ids, "component": ids[low]})
