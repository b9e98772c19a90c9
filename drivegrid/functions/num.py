"""Small numeric Column helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
# Offset of the rounding grid: exact decimals and halves stay away from a bin border, so
# the last bits of a floating sum cannot flip a published digit.
ROUND_OFFSET = 0.4137


def lit(value: float | int | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def quantize(value: Column, digits: int = 6) -> Column:
    """Round for publishing (last step only)."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(ROUND_OFFSET)) / F.lit(scale)


def quantize_sql(expr: str, digits: int = 6) -> str:
    """The same rounding as SQL text."""
    return f"(floor(({expr}) * 1e{digits} + 4.137e-1) / 1e{digits})"


def finite(*values: Column) -> Column:
    """True when every value is present, not NaN and not infinite (never NULL)."""
    tests = [F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(INF)), F.lit(False)) for v in values]
    return reduce(lambda a, b: a & b, tests)


def clamp(value: Column, low: float | Column, high: float | Column) -> Column:
    return F.least(F.greatest(value, lit(low)), lit(high))


def saturating_count(value: Column) -> Column:
    """Counters are published as unsigned 32-bit values."""
    return F.least(value, F.lit(4294967295))


def reason_codes(*rules: tuple[Column, str]) -> Column:
    """Array of the codes whose condition holds: in rule order, each code once."""
    picked = F.array(*[F.when(condition, F.lit(code)) for condition, code in rules])
    return F.array_distinct(F.array_compact(picked))
