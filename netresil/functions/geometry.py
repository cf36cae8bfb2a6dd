"""Plane geometry on Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm2(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def unit_vector(dx: Column, dy: Column) -> tuple[Column, Column]:
    n = norm2(dx, dy) + F.lit(1e-9)
    return dx / n, dy / n


def dot(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * bx + ay * by


def point_segment_distance(px, py, ax, ay, bx, by) -> Column:
    """Distance from a point to a segment, which may be a single point."""
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    along = F.when(len2 == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.nullif(len2, F.lit(0.0))))
    )
    return norm2(px - (ax + along * dx), py - (ay + along * dy))


def gap_direction_score(u1x, u1y, u2x, u2y, gx, gy) -> Column:
    """How well both stubs point at the gap between them."""
    zero = F.lit(0.0)
    return (F.greatest(zero, dot(u1x, u1y, gx, gy)) + F.greatest(zero, dot(u2x, u2y, -gx, -gy))) / 2.0


def curvature(u1x, u1y, u2x, u2y) -> Column:
    """How well both stubs agree with each other."""
    return F.greatest(F.lit(0.0), dot(u1x, u1y, -u2x, -u2y))


def _half_up(num: Column, den: Column) -> Column:
    """round(num / den) for den > 0 on integers, halves up."""
    n = 2 * num + den
    d = 2 * den
    return (n - F.pmod(n, d)) / d


def line_steps(r1: Column, c1: Column, r2: Column, c2: Column) -> Column:
    """Number of steps of the pixel line between two pixels."""
    return F.greatest(F.abs(r2 - r1), F.abs(c2 - c1))


def line_pixel(i: Column, r1: Column, c1: Column, r2: Column, c2: Column) -> tuple[Column, Column]:
    """The i-th pixel of the line: the minor axis in exact integer arithmetic."""
    n = F.greatest(line_steps(r1, c1, r2, c2), F.lit(1))
    row = r1 + _half_up(i * (r2 - r1), n)
    col = c1 + _half_up(i * (c2 - c1), n)
    return row.cast("bigint"), col.cast("bigint")


def pixel_line(df, r1: str = "r1", c1: str = "c1", r2: str = "r2", c2: str = "c2"):
    """One row per pixel of each line, in columns ``i``, ``r`` and ``c``."""
    ends = [F.col(x) for x in (r1, c1, r2, c2)]
    out = df.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), line_steps(*ends).cast("bigint"))))
    row, col = line_pixel(F.col("i"), *ends)
    return out.withColumns({"r": row, "c": col})
