"""Rounding decided on the number itself, not on the digits it is printed with."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double into two halves whose products are exact (Dekker 1971).
_SPLIT = float(2**27 + 1)
#: From here on a double has no fraction left.
_WHOLE = float(2**52)


def round_even(value: Column | str, places: int) -> Column:
    """``value`` to ``places`` decimals; an exact half goes to the even digit.

    The product with the power of ten is taken with its error term, so a half
    is a half only if the double is one: 1.015 lies below and gives 1.01, 1.225
    lies above and gives 1.23. Nulls, NaN and infinities stay.
    """
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    scale = float(10**places)
    p = x * scale
    # p + rest is the exact product
    t = x * _SPLIT
    high = t - (t - x)
    low = x - high
    t = F.lit(scale * _SPLIT)
    s_high = t - (t - F.lit(scale))
    s_low = F.lit(scale) - s_high
    rest = ((high * s_high - p) + high * s_low + low * s_high) + low * s_low
    down = F.floor(p)
    over = (p - down) - 0.5
    up = (over > 0) | ((over == 0) & (rest > 0)) | ((over == 0) & (rest == 0) & (down % 2 != 0))
    digits = F.when(up, down + 1).otherwise(down)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(p) >= _WHOLE), x).otherwise(digits / F.lit(scale))
