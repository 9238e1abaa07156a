"""Arithmetic with the null, infinity and rounding rules the operators need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

INF = float("inf")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: str | Column, low: float | Column, high: float | Column) -> Column:
    """Bound a value; NULL stays NULL (greatest/least alone would turn it into a bound)."""
    c = col(c)
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(c.isNotNull(), F.greatest(low, F.least(high, c)))


def clip_or(c: str | Column, default: float, low: float, high: float) -> Column:
    """Fill NULL first, then bound: the form the score formulas use."""
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.coalesce(col(c), F.lit(float(default)))))


def rounded(c: str | Column, digits: int) -> Column:
    """Half-even on the scaled double, which is what array libraries do; SQL round() works on decimal text."""
    scale = float(10**digits)
    return F.rint(col(c) * F.lit(scale)) / F.lit(scale)


def div_or_zero(a: str | Column, b: str | Column) -> Column:
    return F.coalesce(F.try_divide(col(a), col(b)), F.lit(0.0))


def div_float(a: str | Column, b: str | Column) -> Column:
    """IEEE division: x/0 is a signed infinity, 0/0 is NULL. Plain division raises under ANSI."""
    a, b = col(a), col(b)
    at_zero = F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF))
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def change(current: str | Column, base: str | Column) -> Column:
    return div_float(current, base) - F.lit(1.0)


def nonzero(c: str | Column) -> Column:
    c = col(c)
    return F.when(c != 0, c)


def known(c: str | Column) -> Column:
    """A double whose NaN counts as missing, as NULL does."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def number(c: str | Column) -> Column:
    """Numeric coercion where bad text and NaN become NULL."""
    return known(col(c).try_cast("double"))


def min_obs(agg: Column, counted: Column, frame: WindowSpec, minimum: int) -> Column:
    """Windowed aggregate that is NULL until `minimum` non-null observations are in the frame."""
    return F.when(F.count(counted).over(frame) >= minimum, agg.over(frame))


def saturated_tanh(c: str | Column, scale: float) -> Column:
    """tanh kept strictly inside (-1, 1): the last representable step is pulled to 0.999999."""
    if scale <= 0:
        raise ValueError("scale must be positive")
    t = F.tanh(col(c) / F.lit(float(scale)))
    return F.when(t >= 1.0, F.lit(0.999999)).when(t <= -1.0, F.lit(-0.999999)).otherwise(t)
