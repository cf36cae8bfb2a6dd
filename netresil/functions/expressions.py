"""Scalar rules as Column expressions; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netresil.functions.rounding import round_even

# They must equal the published behaviour for equal results.
SPEED_MS = 11.1
ROAD_CLASS_CONGESTION = [
    ("motorway", 1.2),
    ("trunk", 1.3),
    ("primary", 1.5),
    ("secondary", 1.8),
    ("tertiary", 2.0),
    ("residential", 2.5),
]
OTHER_ROAD_CONGESTION = 2.0
CONGESTION_BANDS = [(3.0, "HIGH"), (2.0, "MEDIUM"), (1.3, "LOW")]
CRITICALITY_STYLE = [(0.7, "#0F6E56", 4), (0.3, "#BA7517", 2)]
LOWEST_STYLE = ("#9A9A9A", 1)
WCS_WEIGHTS = {"D": 0.35, "S": 0.25, "W": 0.20, "C": 0.20}
POPULATION_DENSITY_KM2 = 11_000
POPULATION_SHARE = 0.35
METRES_PER_DEGREE = 111_320.0
DISCONNECTED_HINT = (
    "No path found. These areas may be on disconnected road segments. "
    "Try areas that are geographically closer or on major roads."
)


def _ladder(value: Column, steps, otherwise) -> Column:
    """First label whose lower bound the value reaches."""
    out = None
    for bound, label in steps:
        cond = value >= F.lit(bound)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def clip(value: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(value, F.lit(lo)), F.lit(hi))


def road_class_congestion(highway: Column) -> Column:
    """Congestion multiplier of a road class; unknown class counts as residential."""
    kind = F.coalesce(highway, F.lit("residential"))
    out = None
    for word, value in ROAD_CLASS_CONGESTION:
        hit = kind.contains(word)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(F.lit(OTHER_ROAD_CONGESTION))


def first_class(highways: Column) -> Column:
    """A way with several classes counts as the first of them."""
    return F.get(highways, F.lit(0))


def travel_time(length_m: Column, congestion: Column, missing_length: float = 100.0) -> Column:
    return F.coalesce(length_m, F.lit(missing_length)) / F.lit(SPEED_MS) * congestion


def congestion_band(congestion: Column) -> Column:
    return _ladder(congestion, CONGESTION_BANDS, "VERY LOW")


def congestion_color(congestion: Column) -> Column:
    return (
        F.when(congestion < 2, F.lit("#2ecc71"))
        .when(congestion < 3.5, F.lit("#f1c40f"))
        .otherwise(F.lit("#e74c3c"))
    )


def criticality_color(score: Column) -> Column:
    return _ladder(score, [(b, c) for b, c, _ in CRITICALITY_STYLE], LOWEST_STYLE[0])


def criticality_width(score: Column) -> Column:
    return _ladder(score, [(b, w) for b, _, w in CRITICALITY_STYLE], LOWEST_STYLE[1])


def segment_length(length_m: Column) -> Column:
    return round_even(F.coalesce(length_m, F.lit(0.0)), 1)


def segment_score(length_m: Column, congestion: Column) -> Column:
    raw = segment_length(length_m) / 500.0 * 0.4 + congestion / 2.0 * 0.6
    return round_even(F.least(F.lit(0.99), raw), 3)


def segment_criticality(score: Column) -> Column:
    return F.when(score > 0.75, "CRITICAL").when(score > 0.5, "HIGH").otherwise("MEDIUM")


def priority_score(removed: Column, before: Column, after: Column) -> Column:
    return round_even(F.least(F.lit(1.0), removed * 0.05 + (before - after) / 50.0), 2)


def emergency_priority(score: Column) -> Column:
    return F.when(score > 0.75, "CRITICAL").when(score > 0.45, "HIGH").otherwise("MEDIUM")


def feature_id(prefix: str, u: Column, v: Column) -> Column:
    return F.concat_ws("-", F.lit(prefix), u.cast("string"), v.cast("string"))


def short_id(segment_id: Column) -> Column:
    return F.substring(F.replace(segment_id, F.lit("SEG-"), F.lit("SG-")), 1, 10)


def to_lonlat(pair: Column) -> Column:
    """Order a coordinate pair as lon, lat; latitudes here never exceed 40."""
    a, b = pair[0], pair[1]
    return F.when(a > 40, F.array(a, b)).otherwise(F.array(b, a))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    sp, sl = F.sin((p2 - p1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = sp * sp + F.cos(p1) * F.cos(p2) * sl * sl
    return F.lit(6_371_000.0) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def pixel_x(meta: Column, row: Column, col: Column) -> Column:
    return meta["c"] + meta["a"] * (col + 0.5) + meta["b"] * (row + 0.5)


def pixel_y(meta: Column, row: Column, col: Column) -> Column:
    return meta["f"] + meta["d"] * (col + 0.5) + meta["e"] * (row + 0.5)


def pixel_size_m(meta: Column, geographic: Column, height: Column, width: Column) -> Column:
    """Pixel width in metres; on a geographic grid, one pixel at the centre."""
    row, col = height / 2, width / 2
    step = haversine_m(
        pixel_x(meta, row, col), pixel_y(meta, row, col),
        pixel_x(meta, row, col + 1), pixel_y(meta, row, col + 1),
    )
    return F.when(geographic, step).otherwise(F.abs(meta["a"]))


def pixel_size_rough(a: Column) -> Column:
    """Widths below 0.001 are taken for degrees; half a metre when unknown."""
    size = F.abs(a)
    return F.coalesce(F.when(size < 0.001, size * 111_000).otherwise(size), F.lit(0.5))


def metres_to_degrees(radius_m: Column, lat: Column) -> tuple[Column, Column]:
    """(lon, lat) extent in degrees of a distance at a latitude."""
    return (
        radius_m / (F.lit(METRES_PER_DEGREE) * F.cos(F.radians(lat))),
        radius_m / METRES_PER_DEGREE,
    )


def width_similarity(w1: Column, w2: Column, floor: float | None = None) -> Column:
    """1 for equal widths; ``floor`` joins the maximum in the training variant."""
    top = F.greatest(w1, w2) if floor is None else F.greatest(w1, w2, F.lit(floor))
    return 1.0 - F.abs(w1 - w2) / top


def wcs(d: Column, s: Column, w: Column, c: Column) -> Column:
    k = WCS_WEIGHTS
    return k["D"] * d + k["S"] * s + k["W"] * w + k["C"] * c


def heuristic_score(d: Column, c: Column, vetoed: Column) -> Column:
    return F.when(vetoed, F.lit(0.0)).otherwise(0.7 * d + 0.3 * c)


def congestion_from_density(density: Column, p95: Column) -> Column:
    return 1.0 + 4.0 * clip(density / p95, 0.0, 1.0)


def population_fallback(radius_m: Column) -> Column:
    """Head count assumed for a disc where no raster is at hand."""
    km = radius_m / 1000.0
    return F.floor(F.pi() * (km * km) * POPULATION_DENSITY_KM2 * POPULATION_SHARE)


def default_origin_lat(lat: Column) -> Column:
    return round_even(round_even(lat, 4) + 0.02, 4)


def default_destination_lat(lat: Column) -> Column:
    return round_even(round_even(lat, 4) - 0.02, 4)


def improved(before: Column, after: Column, lower_is_better: bool = False) -> Column:
    return after < before if lower_is_better else after > before


def fixed_text(value: Column, decimals: int) -> Column:
    return F.replace(F.format_number(value, decimals), F.lit(","), F.lit(""))


def route_status_label(status: Column) -> Column:
    return F.when(status == "success", "OK").when(status == "isolated", "ISO").otherwise("FAIL")


def friendly_message(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("Unknown error")))
    vague = low.contains("disconnected") | low.contains("no navigable")
    return F.when(vague, F.lit(DISCONNECTED_HINT)).otherwise(F.coalesce(message, F.lit("Unknown error")))


def percent(part: Column, whole: Column) -> Column:
    return part * 100.0 / F.greatest(whole, F.lit(1))


def density_flag(pct: Column) -> Column:
    return F.when(pct < 0.1, "too few").when(pct > 30, "too many").otherwise("optimal")


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def sar_db(power: Column, offset: float = 0.0) -> Column:
    """Power in decibels; not positive counts as -30."""
    return F.when(power > 0, 10 * F.log10(power + F.lit(offset))).otherwise(F.lit(-30.0))


def sar_db_fixed(power: Column, lo: float, hi: float) -> Column:
    return (clip(sar_db(power), lo, hi) - F.lit(lo)) / F.lit(hi - lo)


def clean_nodata(value: Column, nodata: float = -99999.0) -> Column:
    v = F.nanvl(F.coalesce(value, F.lit(0.0)), F.lit(0.0))
    return F.when((v == F.lit(nodata)) | (v < 0), F.lit(0.0)).otherwise(v)


def is_valid_positive(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (value > 0) & (value < F.lit(float("inf")))
