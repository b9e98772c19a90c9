"""Grid buckets that turn distance and range predicates into equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def bucket(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(float(size)))


def with_cell(df: DataFrame, x: Column, y: Column, size: float, names=("_bx", "_by")) -> DataFrame:
    return df.withColumns({names[0]: bucket(x, size), names[1]: bucket(y, size)})


def cover_box(df, x0, x1, y0, y1, size: float, names=("_bx", "_by")) -> DataFrame:
    """One copy of the row for each bucket its box touches."""
    bx = F.sequence(bucket(x0, size), bucket(x1, size))
    by = F.sequence(bucket(y0, size), bucket(y1, size))
    return df.withColumn(names[0], F.explode(bx)).withColumn(names[1], F.explode(by))


def spread_offsets(df: DataFrame, x: str, y: str, reach: int, keep: Column | None = None) -> DataFrame:
    """Copy each cell row to all cells within ``reach`` (square), adding dx and dy; ``keep``
    may narrow the square.  Offsets are generated per row: nothing is broadcast."""
    axis = F.sequence(F.lit(-reach).cast("long"), F.lit(reach).cast("long"))
    out = df.withColumn("dx", F.explode(axis)).withColumn("dy", F.explode(axis))
    if keep is not None:
        out = out.filter(keep)
    return out.withColumns({x: F.col(x) + F.col("dx"), y: F.col(y) + F.col("dy")})


def is_few(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a measured size; larger sides are left to a shuffle join."""
    return F.broadcast(df) if is_few(df, rows) else df
