"""Row filters on point and pixel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clip_bbox(df: DataFrame, lon: str, lat: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows inside ``(min_lon, min_lat, max_lon, max_lat)``; reaches the scan as ranges."""
    return df.where(F.col(lon).between(box[0], box[2]) & F.col(lat).between(box[1], box[3]))
