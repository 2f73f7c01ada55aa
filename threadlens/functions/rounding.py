"""Exact one-decimal rounding of ratios (half-even on the exact quotient).

``round(100*c/n, 1)`` on doubles depends on binary representation; the exact
answer is computed on integers so that every engine and thread size agrees:
q = c*1000 div n, r = c*1000 mod n, round half to even on (q, r).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def half_even_div(num, den) -> Column:
    """round_half_even(num / den) for non-negative integer columns, as BIGINT."""
    num, den = _c(num).cast("bigint"), _c(den).cast("bigint")
    q = F.floor(F.try_divide(num, den)).cast("bigint")
    r = num - q * den
    bump = (r * 2 > den) | ((r * 2 == den) & (q % 2 == 1))
    return F.when(den > 0, q + F.when(bump, 1).otherwise(0))


def pct_tenths(count, total) -> Column:
    """Percentage of count in total, in tenths of a percent (BIGINT); 0 when total is 0."""
    return F.coalesce(half_even_div(_c(count).cast("bigint") * 1000, total), F.lit(0).cast("bigint"))


def pct1(count, total) -> Column:
    """Percentage with one decimal as DOUBLE (what ``round(100*c/n, 1)`` means exactly)."""
    return pct_tenths(count, total) / F.lit(10.0)


def tenths_str(tenths) -> Column:
    """Render tenths as Python prints a one-decimal float: 287 -> '28.7', 800 -> '80.0'."""
    t = _c(tenths).cast("bigint")
    sign = F.when(t < 0, F.lit("-")).otherwise(F.lit(""))
    a = F.abs(t)
    return F.concat(sign, F.floor(a / 10).cast("bigint").cast("string"), F.lit("."),
                    (a % 10).cast("string"))
