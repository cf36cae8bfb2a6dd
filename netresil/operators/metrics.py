"""Segmentation scores, loss values, precision-recall curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netresil.functions import expressions as X
from netresil.session import cut_lineage

EPS = 1e-6


def confusion_metrics(df: DataFrame, logit: str, target: str, t: float = 0.40, keys: Sequence[str] = ()) -> DataFrame:
    """Counts over all pixels first, ratios once at the end."""
    hit, true = X.sigmoid(F.col(logit)) > t, F.col(target) > 0
    c = df.groupBy(*keys).agg(
        F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(
        *keys, "tp", "fp", "fn",
        (tp / (tp + fp + fn + EPS)).alias("iou"),
        (2.0 * tp / (2.0 * tp + fp + fn + EPS)).alias("dice"),
        (tp / (tp + fp + EPS)).alias("precision"),
        (tp / (tp + fn + EPS)).alias("recall"),
    )


def loss_metrics(df: DataFrame, logit: str, target: str, pos_weight: float = 3.0, alpha: float = 0.3, beta: float = 0.7,
                 smooth: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """Cross-entropy, Tversky, their 0.6/0.4 mix, Dice, and half Dice, half cross-entropy."""
    x, y = F.col(logit), F.col(target).cast("double")
    p = X.sigmoid(x)
    # log(1 + e^-|x|) keeps both logarithms finite
    soft = F.log1p(F.exp(-F.abs(x)))
    neg_log_p = F.greatest(-x, F.lit(0.0)) + soft
    neg_log_q = F.greatest(x, F.lit(0.0)) + soft
    s = df.groupBy(*keys).agg(
        F.avg(pos_weight * y * neg_log_p + (1 - y) * neg_log_q).alias("wbce"), F.avg(y * neg_log_p + (1 - y) * neg_log_q).alias("bce"),
        F.sum(p * y).alias("tp"), F.sum(p * (1 - y)).alias("fp"), F.sum((1 - p) * y).alias("fn"),
        F.sum(p).alias("sp"), F.sum(y).alias("sy"),
    )
    tversky = 1 - (F.col("tp") + smooth) / (F.col("tp") + alpha * F.col("fp") + beta * F.col("fn") + smooth)
    dice = 1 - (2 * F.col("tp") + smooth) / (F.col("sp") + F.col("sy") + smooth)
    return s.select(
        *keys, F.col("wbce").alias("bce"), tversky.alias("tversky"), (0.6 * tversky + 0.4 * F.col("wbce")).alias("road_loss"),
        dice.alias("dice_loss"), (0.5 * dice + 0.5 * F.col("bce")).alias("dice_bce"),
    )


def pr_curve(scores: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Precision and recall at every distinct score, ``threshold`` descending.

    Scores are counted map-side; the running sums go over range partitions
    with carried totals, so the curve never passes through one task.
    """
    g = scores.groupBy(F.col(score).alias("threshold")).agg(
        F.sum(F.col(label)).cast("bigint").alias("pos"), F.count(F.lit(1)).alias("n")
    )
    g = cut_lineage(g.repartitionByRange("threshold").withColumn("_p", F.spark_partition_id()))
    part = g.groupBy("_p").agg(F.sum("pos").alias("_pos"), F.sum("n").alias("_n"))
    later = Window.orderBy(F.col("_p").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    part = part.select(  # one row per partition
        "_p", F.coalesce(F.sum("_pos").over(later), F.lit(0)).alias("bp"),
        F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("bn"), F.sum("_pos").over(whole).alias("total"),
    )
    down = Window.partitionBy("_p").orderBy(F.col("threshold").desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = g.join(F.broadcast(part), "_p").withColumns(
        {"tp": F.sum("pos").over(down) + F.col("bp"), "seen": F.sum("n").over(down) + F.col("bn")}
    )
    return run.select(
        "threshold", F.col("tp").cast("bigint").alias("tp"), (F.col("tp") / F.col("seen")).alias("precision"),
        F.when(F.col("total") > 0, F.col("tp") / F.nullif("total", F.lit(0))).otherwise(1.0).alias("recall"),
    )


def best_f1_threshold(curve: DataFrame) -> DataFrame:
    """Threshold of the highest F1; the smallest wins ties; 0.5 on an empty curve.

    The curve's end point (precision 1, recall 0) has F1 = 0 and wins only
    when no threshold does better.
    """
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-9)
    best = curve.withColumn("f1", f1).agg(
        F.max_by("threshold", F.struct(F.col("f1"), -F.col("threshold"))).alias("threshold"), F.max("f1").alias("f1")
    )
    return best.select(F.coalesce("threshold", F.lit(0.5)).alias("threshold"), "f1")


def f1_at(scores: DataFrame, threshold: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """F1 of ``score >= threshold``; the threshold is a one-row table."""
    hit = F.col(score) >= F.col("threshold")
    c = scores.join(F.broadcast(threshold.select("threshold"))).agg(  # one row
        F.count_if(hit & (F.col(label) == 1)).alias("tp"), F.count_if(hit & (F.col(label) == 0)).alias("fp"),
        F.count_if(~hit & (F.col(label) == 1)).alias("fn"),
    )
    d = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return c.select("tp", "fp", "fn", F.when(d > 0, 2.0 * F.col("tp") / F.nullif(d, F.lit(0))).otherwise(0.0).alias("f1"))


def mean_over_samples(df: DataFrame, run: Sequence[str], sample: Sequence[str], value: str) -> DataFrame:
    """Unweighted mean of the per-sample means."""
    return df.groupBy(*run, *sample).agg(F.avg(value).alias("m")).groupBy(*run).agg(F.avg("m").alias(f"mean_{value}"))
