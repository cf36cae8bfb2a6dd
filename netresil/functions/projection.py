"""Transverse Mercator (UTM, WGS 84) as Column expressions.

Series in the third flattening after Krüger, as given by Karney (2011),
"Transverse Mercator with an accuracy of a few nanometers".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The WGS 84 ellipsoid and the UTM grid.
A = 6378137.0
FLAT = 1 / 298.257223563
K0 = 0.9996
FALSE_EASTING = 500000.0

N = FLAT / (2 - FLAT)
E = (FLAT * (2 - FLAT)) ** 0.5
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
# forward and inverse series coefficients, orders 1 to 4
ALPHA = [
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440,
    61 * N**3 / 240 - 103 * N**4 / 140,
    49561 * N**4 / 161280,
]
BETA = [
    N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360,
    N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440,
    17 * N**3 / 480 - 37 * N**4 / 840,
    4397 * N**4 / 161280,
]
DELTA = [
    2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45,
    7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45,
    56 * N**3 / 15 - 136 * N**4 / 35,
    4279 * N**4 / 630,
]


def central_meridian(zone: int) -> float:
    return zone * 6.0 - 183.0


def wgs84_to_utm(lon: Column, lat: Column, zone: int = 43) -> tuple[Column, Column]:
    """(easting, northing) on the northern half of a UTM zone."""
    lam = F.radians(lon - F.lit(central_meridian(zone)))
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - F.lit(E) * F.atanh(F.lit(E) * s))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for k, a in enumerate(ALPHA, 1):
        x = x + F.lit(a) * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        y = y + F.lit(a) * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    scale = F.lit(K0 * RADIUS)
    return scale * x + F.lit(FALSE_EASTING), scale * y


def utm_to_wgs84(x: Column, y: Column, zone: int = 43) -> tuple[Column, Column]:
    """(lon, lat) of a point on the northern half of a UTM zone."""
    xi0 = y / F.lit(K0 * RADIUS)
    eta0 = (x - F.lit(FALSE_EASTING)) / F.lit(K0 * RADIUS)
    xi, eta = xi0, eta0
    for k, b in enumerate(BETA, 1):
        xi = xi - F.lit(b) * F.sin(2 * k * xi0) * F.cosh(2 * k * eta0)
        eta = eta - F.lit(b) * F.cos(2 * k * xi0) * F.sinh(2 * k * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for k, d in enumerate(DELTA, 1):
        lat = lat + F.lit(d) * F.sin(2 * k * chi)
    lon = F.lit(central_meridian(zone)) + F.degrees(F.atan2(F.sinh(eta), F.cos(xi)))
    return lon, F.degrees(lat)


def transform_bounds(boxes: DataFrame, to_utm: bool, keys: list[str], zone: int = 43, steps: int = 20) -> DataFrame:
    """Bounding box of the reprojected outline of each box.

    ``boxes`` has ``keys`` and ``min_x, min_y, max_x, max_y``; each side is
    cut into ``steps`` pieces, since straight sides bend when projected.
    """
    t = (F.col("i") % steps) / F.lit(float(steps))
    side = F.floor(F.col("i") / steps)
    w, h = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    px = (
        F.when(side == 0, F.col("min_x") + w * t).when(side == 1, F.col("max_x"))
        .when(side == 2, F.col("max_x") - w * t).otherwise(F.col("min_x"))
    )
    py = (
        F.when(side == 0, F.col("min_y")).when(side == 1, F.col("min_y") + h * t)
        .when(side == 2, F.col("max_y")).otherwise(F.col("max_y") - h * t)
    )
    ring = boxes.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4 * steps - 1)))).select(
        *keys, px.alias("px"), py.alias("py")
    )
    conv = wgs84_to_utm if to_utm else utm_to_wgs84
    qx, qy = conv(F.col("px"), F.col("py"), zone)
    return ring.select(*keys, qx.alias("qx"), qy.alias("qy")).groupBy(*keys).agg(
        F.min("qx").alias("min_x"), F.min("qy").alias("min_y"),
        F.max("qx").alias("max_x"), F.max("qy").alias("max_y"),
    )
