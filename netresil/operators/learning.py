"""Splits, sampling, scaling and the logistic gap model.

Random choices are orders by keyed hash: the same rows give the same choice
however they are partitioned.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netresil.functions import expressions as X
from netresil.operators.routing import ranked

FEATURES = ["D", "S", "W", "C"]
MODEL_VERSION = "gap-logistic-1"
#: How often a step that raises the loss is halved before the fit ends.
HALVINGS = 30


def keyed_order(seed: int, *cols: str) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def split3(df: DataFrame, order: Sequence[str], val: float = 0.15, test: float = 0.15) -> DataFrame:
    """Exact-size split by ascending ``order``: test and val get int(n x ratio).

    Pass a keyed hash as the first order column for a random split. Positions
    come from a range partitioning, not from one sorted task. Rows of equal
    order are told apart by a hash of all their columns; every row comes out
    once.
    """
    n = df.count()
    n_val, n_test = int(n * val), int(n * test)
    n_train = n - n_val - n_test
    p = F.col("pos")
    part = F.when(p < n_train, "train").when(p < n_train + n_val, "val").otherwise("test")
    return ranked(df, order).withColumn("split", part).drop("pos")


def cap_per_tile(df: DataFrame, tile: str, label: str, caps: dict[int, int], order: Column) -> DataFrame:
    """At most ``caps[label]`` rows per tile and class: the cap is the feature.

    One tile is a bounded piece of raster, so the window stays bounded.
    """
    w = Window.partitionBy(tile, label).orderBy(order)
    cap = F.coalesce(*[F.when(F.col(label) == k, F.lit(v)) for k, v in caps.items()], F.lit(0))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def first_by_order(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The n smallest rows under ``order``, by position over range partitions; exactly n, also under ties."""
    return ranked(df, order).where(F.col("pos") < n).drop("pos")


def balance(df: DataFrame, label: str, order: Sequence[str], ratio: int = 3) -> DataFrame:
    """min(P, N // ratio) positives and ``ratio`` times as many negatives."""
    p, n = df.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
    take = min(p, n // ratio)
    pos = first_by_order(df.where(F.col(label) == 1), order, take)
    return pos.unionByName(first_by_order(df.where(F.col(label) == 0), order, take * ratio))


def fit_scale(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row of means and population deviations (1 where a column is flat)."""
    return train.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in cols],
        *[F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"std_{c}") for c in cols],
    )


def standard_scale(df: DataFrame, scale: DataFrame, cols: Sequence[str]) -> DataFrame:
    wide = df.join(F.broadcast(scale))  # one row
    out = wide.withColumns({c: (F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}") for c in cols})
    return out.drop(*[f"mean_{c}" for c in cols], *[f"std_{c}" for c in cols])


@dataclass(frozen=True)
class Logistic:
    """A fitted model: score = sigmoid(weights . features + intercept)."""

    cols: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float

    def margin(self) -> Column:
        """Weighted sum of the features; null if one is null or not a number."""
        out = F.lit(self.intercept)
        for c, w in zip(self.cols, self.weights):
            out = out + F.lit(w) * F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        return out


def logistic_fit(
    train: DataFrame, cols: Sequence[str] = tuple(FEATURES), label: str = "label", c: float = 1.0, steps: int = 8, tol: float = 1e-10
) -> Logistic:
    """L2-regularised logistic regression; strength 1/(C n) on the mean loss, none on the intercept.

    Newton steps from zero weights. A step needs the loss, its slopes and its
    curvatures at one point: sums over all rows, added up map-side in one pass,
    so k features bring (k + 1)(k + 4) / 2 + 1 numbers to the driver however
    many rows there are. A step that raises the loss is halved. The fit ends
    after ``steps`` steps or when no weight moves by more than ``tol``.
    Rows with a null or non-numeric feature or label are left out. Without rows
    all weights are 0; with a single label the intercept is as far as ``steps``
    steps carry it. Features should be scaled; ``train`` is read once per step,
    so give a written table.
    """
    cols = tuple(cols)
    number = lambda k: F.nanvl(F.col(k).cast("double"), F.lit(None).cast("double"))
    rows = train.select(*[number(k).alias(f"x{i}") for i, k in enumerate(cols)], number(label).alias("y")).dropna()
    at = np.zeros(len(cols) + 1)
    n, loss, slope, curve = _sums(rows, at, c)
    if n == 0:
        return Logistic(cols, (0.0,) * len(cols), 0.0)
    for _ in range(steps):
        move = np.linalg.lstsq(curve, -slope, rcond=None)[0]
        for _ in range(HALVINGS):
            new = _sums(rows, at + move, c)
            if new[1] <= loss + 1e-12 * abs(loss):
                break
            move = move / 2
        else:
            break
        at = at + move
        _, loss, slope, curve = new
        if np.abs(move).max() <= tol:
            break
    return Logistic(cols, tuple(map(float, at[:-1])), float(at[-1]))


def _sums(rows: DataFrame, at: np.ndarray, c: float) -> tuple[int, float, np.ndarray, np.ndarray]:
    """Rows, loss, slopes and curvatures of the summed loss plus |w|^2 / (2 C) at one point, in one pass over ``x0..., y``."""
    k = len(at) - 1
    names = tuple(f"x{i}" for i in range(k))
    z = Logistic(names, tuple(map(float, at[:-1])), float(at[-1])).margin()
    x = [*map(F.col, names), F.lit(1.0)]
    y, z_, p = F.col("y"), F.col("z"), F.col("p")
    pairs = [(i, j) for i in range(k + 1) for j in range(i + 1)]
    got = rows.withColumn("z", z).withColumn("p", X.sigmoid(z_)).agg(
        F.count(F.lit(1)),
        # log(1 + e^z) - y z, without overflow
        F.coalesce(F.sum(F.greatest(z_, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z_))) - y * z_), F.lit(0.0)),
        *[F.coalesce(F.sum((p - y) * v), F.lit(0.0)) for v in x],
        *[F.coalesce(F.sum(p * (1 - p) * x[i] * x[j]), F.lit(0.0)) for i, j in pairs],
    ).first()
    pull = np.append(np.full(k, 1.0 / c), 0.0)
    slope = np.array(got[2:k + 3]) + pull * at
    curve = np.diag(pull)
    for (i, j), v in zip(pairs, got[k + 3:]):
        curve[i, j] += v
        if i != j:
            curve[j, i] += v
    return got[0], got[1] + float((pull * at * at).sum()) / 2, slope, curve


def logistic_score(model: Logistic, df: DataFrame) -> DataFrame:
    """Probability of class 1 as ``score``; null where a feature is null or not a number."""
    return df.withColumn("score", X.sigmoid(model.margin()))


def formula(spark, model: Logistic, threshold: float) -> DataFrame:
    """Weights, intercept and threshold of a fitted model, one row."""
    return spark.range(1).select(
        *[F.lit(w).alias(f"w_{k}") for k, w in zip(model.cols, model.weights)], F.lit(model.intercept).alias("b"),
        F.lit(float(threshold)).alias("threshold"), F.lit(MODEL_VERSION).alias("version"),
    )


def save_model(spark, model: Logistic, threshold: float, path: str) -> None:
    formula(spark, model, threshold).write.mode("overwrite").parquet(f"{path}/formula")


def load_model(spark, path: str) -> tuple[Logistic, float]:
    """A saved model and its threshold."""
    row = spark.read.parquet(f"{path}/formula").first()
    cols = tuple(k[2:] for k in row.asDict() if k.startswith("w_"))
    return Logistic(cols, tuple(row[f"w_{k}"] for k in cols), row["b"]), row["threshold"]


def class_feature_means(df: DataFrame, cols: Sequence[str] = tuple(FEATURES), label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in cols])


def label_stats(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
