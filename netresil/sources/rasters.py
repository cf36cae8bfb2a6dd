"""Pixel tables on disk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TILE = 1024  # pixels per partition side


def with_tiles(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    return pixels.withColumns({
        "tile_r": F.floor(F.col("r") / tile).cast("int"), "tile_c": F.floor(F.col("c") / tile).cast("int"),
    })


def write_pixels(pixels: DataFrame, path: str, dtype: str = "double", compression: str = "zstd", tile: int = TILE) -> None:
    """Store ``raster_id, band, r, c, value`` by raster and tile, in ``dtype``.

    Rows are brought together per tile so that each holds few files.
    """
    out = with_tiles(pixels, tile).withColumn("value", F.col("value").cast(dtype))
    (
        out.repartition("raster_id", "tile_r", "tile_c").sortWithinPartitions("band", "r", "c")
        .write.mode("overwrite").option("compression", compression).partitionBy("raster_id", "tile_r", "tile_c").parquet(path)
    )


def read_pixels(spark: SparkSession, path: str, raster_id: str | None = None, bands: Sequence[int] | None = None) -> DataFrame:
    """Pixel table; raster and bands are pruned at the scan."""
    df = spark.read.parquet(path)
    if raster_id is not None:
        df = df.where(F.col("raster_id") == raster_id)
    if bands is not None:
        df = df.where(F.col("band").isin(list(bands)))
    return df


def read_window(spark: SparkSession, path: str, raster_id: str, r0: int, r1: int, c0: int, c1: int, tile: int = TILE) -> DataFrame:
    """Sub-rectangle, ends excluded: whole tiles outside it are never opened."""
    return read_pixels(spark, path, raster_id).where(
        F.col("tile_r").between(r0 // tile, (r1 - 1) // tile) & F.col("tile_c").between(c0 // tile, (c1 - 1) // tile)
        & (F.col("r") >= r0) & (F.col("r") < r1) & (F.col("c") >= c0) & (F.col("c") < c1)
    )


def cache_features(build, path: str, spark: SparkSession) -> DataFrame:
    """Features from ``path`` if complete there, else built and written first."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def buffer_bbox(df: DataFrame, frac: float | None = 0.10, degrees: float | None = None) -> DataFrame:
    """Grow ``min_x, min_y, max_x, max_y`` by a share of the extent or by degrees."""
    dx = F.lit(degrees) if degrees is not None else (F.col("max_x") - F.col("min_x")) * frac
    dy = F.lit(degrees) if degrees is not None else (F.col("max_y") - F.col("min_y")) * frac
    return df.withColumns({
        "min_x": F.col("min_x") - dx, "min_y": F.col("min_y") - dy, "max_x": F.col("max_x") + dx, "max_y": F.col("max_y") + dy,
    })


def band_power(df: DataFrame) -> DataFrame:
    """Complex samples ``re, im`` -> power ``value``."""
    return df.withColumn("value", F.col("re") * F.col("re") + F.col("im") * F.col("im"))
