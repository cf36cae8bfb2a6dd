"""Metric histories: one row per run and epoch, a few hundred rows per run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The optical reference score and trend limits.
BASELINE_IOU = 0.2155
TREND_STEP = 0.005


def last_n_trend(history: DataFrame, n: int = 5, metric: str = "val_iou") -> DataFrame:
    """Change over each run's last n epochs; runs with fewer get no row."""
    newest = Window.partitionBy("run").orderBy(F.col("epoch").desc())
    tail = history.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= n)
    g = tail.groupBy("run").agg(
        (F.max_by(metric, "epoch") - F.min_by(metric, "epoch")).alias("delta"), F.count(F.lit(1)).alias("epochs")
    )
    d = F.col("delta")
    trend = F.when(d > TREND_STEP, "improving").when(d > -TREND_STEP, "plateauing").otherwise("declining")
    return g.where(F.col("epochs") >= n).select("run", "delta", trend.alias("trend"))


def best_and_last(history: DataFrame, metric: str = "val_iou") -> DataFrame:
    """Best epoch (the first wins ties) and last epoch of each run."""
    return history.groupBy("run").agg(
        F.max_by("epoch", F.struct(F.col(metric), -F.col("epoch"))).alias("best_epoch"),
        F.max(metric).alias("best"), F.max("epoch").alias("last_epoch"), F.max_by(metric, "epoch").alias("last"),
        F.count(F.lit(1)).alias("epochs"),
    )


def early_stop(history: DataFrame, patience: int, metric: str = "val_iou", save_every: int = 5) -> DataFrame:
    """Per epoch: best so far, improvement, epochs without one, stop and save flags."""
    w = Window.partitionBy("run").orderBy("epoch")
    before = F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = F.col(metric) > F.greatest(F.coalesce(before, F.lit(0.0)), F.lit(0.0))
    h = history.select("run", "epoch", metric).withColumns({"improved": better})
    h = h.withColumn("streak_id", F.sum(F.col("improved").cast("int")).over(w))
    inside = Window.partitionBy("run", "streak_id").orderBy("epoch")
    h = h.withColumn("stale", F.when(F.col("streak_id") == 0, F.row_number().over(inside)).otherwise(F.row_number().over(inside) - 1))
    stop = F.min(F.when(F.col("stale") >= patience, F.col("epoch"))).over(Window.partitionBy("run"))
    return h.withColumn("stop_epoch", stop).select(
        "run", "epoch", F.greatest(F.max(metric).over(w), F.lit(0.0)).alias("best"), "improved", "stale", "stop_epoch",
        (F.col("epoch") % save_every == 0).alias("save"),
        (F.col("stop_epoch").isNull() | (F.col("epoch") <= F.col("stop_epoch"))).alias("ran"),
    )


def baseline_delta(history: DataFrame, metric: str = "val_iou", baseline: float = BASELINE_IOU) -> DataFrame:
    d = F.col(metric) - F.lit(baseline)
    return history.select("run", "epoch", metric, d.alias("delta"), (d / F.lit(baseline) * 100).alias("delta_pct"))
