"""Exact shares and rounding.

Percentages are rounded half-up with integer arithmetic and only then
turned into a double, so every engine yields the same value bit for bit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def share(part, total, scale: int = 100, decimals: int = 1) -> Column:
    """round(scale * part / total, decimals) half-up; 0 when total is 0 or NULL."""
    p, t = _c(part).cast("long"), _c(total).cast("long")
    k = scale * 10 ** decimals
    # (2*k*p + t) div (2*t) == round-half-up(k*p/t) for p, t >= 0; exact long maths
    q = idiv(p * (2 * k) + t, t * 2)
    return F.when(t > 0, q.cast("double") / F.lit(float(10 ** decimals))).otherwise(F.lit(0.0))


def idiv(a, b) -> Column:
    """Integral division of longs (SQL ``div``)."""
    return F.call_function("div", _c(a), _c(b))


def share_sql(part: str, total: str, scale: int = 100, decimals: int = 1) -> str:
    """``share`` as SQL text for the oracle queries (DuckDB ``//`` is integral)."""
    k = scale * 10 ** decimals
    return (f"(case when ({total}) > 0 then cast((cast({part} as bigint) * {2 * k} + ({total}))"
            f" // (cast({total} as bigint) * 2) as double) / {float(10 ** decimals)} else 0.0 end)")


def round_half_up(x, decimals: int) -> Column:
    """HALF_UP rounding (Spark's round)."""
    return F.round(_c(x), decimals)
