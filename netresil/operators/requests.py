"""Request tables: defaults and rejection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Request defaults.
SNAP_LIMIT = {"route": 5000.0, "simulate": 3000.0}
RADIUS_M = 800.0
WEIGHT = "travel_time"


def apply_defaults(requests: DataFrame, kind: str, required: list[str]) -> DataFrame:
    """Fill optional fields; ``reason`` names the first missing required one, else ``ok``."""
    reason = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required], F.lit("ok"))
    fill = {
        "max_snap_dist_m": F.coalesce("max_snap_dist_m", F.lit(SNAP_LIMIT[kind])),
        "radius_m": F.coalesce("radius_m", F.lit(RADIUS_M)),
        "reason": reason,
    }
    if "weight_type" in requests.columns:
        fill["weight_type"] = F.coalesce("weight_type", F.lit(WEIGHT))
    return requests.withColumns(fill)


def split_requests(requests: DataFrame, kind: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Accepted requests, and rejected ones with their reason."""
    filled = apply_defaults(requests, kind, required)
    return filled.where(F.col("reason") == "ok").drop("reason"), filled.where(F.col("reason") != "ok")


def element_at_fraction(path: str, part: int):
    """The element one ``part``-th along an ordered array."""
    return F.element_at(path, (F.floor(F.size(path) / part) + 1).cast("int"))


def union_runs(runs: dict[str, DataFrame]) -> DataFrame:
    """Datasets of one shape under a ``run`` tag."""
    out = None
    for name, df in runs.items():
        tagged = df.select(F.lit(name).alias("run"), "*")
        out = tagged if out is None else out.unionByName(tagged)
    return out


def stack_labels(pos: DataFrame, neg: DataFrame) -> DataFrame:
    return pos.withColumn("label", F.lit(1)).unionByName(neg.withColumn("label", F.lit(0)))
