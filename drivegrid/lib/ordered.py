"""Ordered-sequence helpers that never put a whole sequence into one task.

A sequence is a set of rows that share ``keys`` and carry a dense position ``index``
(0, 1, 2, ...).  A single run may hold a third of a fleet's rows, so windows here are
partitioned by ``keys`` *and* a chunk of ``CHUNK_ROWS`` consecutive positions: neighbours
come from copied border rows, running aggregates from a two-level prefix scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from drivegrid.session import cut_lineage

CHUNK_ROWS = 65_536
SMALL_GROUP_ROWS = 1_000_000
_BOUND = "max_sequence_rows"


def with_bound(df: DataFrame, index: str, rows: int | None) -> DataFrame:
    """Note on the index column (column metadata) that no sequence is longer than ``rows``."""
    if rows is None:
        return df
    return df.withColumn(index, F.col(index).alias(index, metadata={_BOUND: int(rows)}))


def bound_of(df: DataFrame, index: str) -> int | None:
    return (df.schema[index].metadata or {}).get(_BOUND)


def measured(df: DataFrame, index: str = "i", source: DataFrame | None = None) -> DataFrame:
    """Measure the longest sequence once (largest dense position) and note it on ``df``; a
    cheaper ``source`` with the same positions may be measured instead."""
    top = (df if source is None else source).agg(F.max(index)).first()[0]
    return with_bound(df, index, 0 if top is None else top + 1)


def is_small(df: DataFrame, index: str) -> bool:
    """True only when a measurement has shown that every sequence fits one task."""
    rows = bound_of(df, index)
    return rows is not None and rows <= SMALL_GROUP_ROWS


def chunk_of(index: str, rows: int) -> Column:
    return F.expr(f"{index} div {rows}L")


def index_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    index: str = "i",
    small_group: int = SMALL_GROUP_ROWS,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Dense 0-based position of each row within ``keys`` by ``order`` (must be unique).

    The largest group is measured first, on ``sized_by`` if given (a cheaper frame whose
    groups are at least as large, such as the input of a filter).  While it fits one task a plain window is used;
    beyond that the rows are range-partitioned by (keys, order), frozen by a reliable
    checkpoint, numbered inside each partition and shifted by the rows before it.
    """
    largest = (df if sized_by is None else sized_by).groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= small_group:
        w = Window.partitionBy(*keys).orderBy(*order)
        numbered = df.withColumn(index, F.row_number().over(w).cast("long") - 1)
        return with_bound(numbered, index, largest)
    ranged = df.repartitionByRange(*[F.col(c) for c in (*keys, *order)])
    ranged = cut_lineage(ranged.withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        *keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")
    )
    inner = Window.partitionBy(*keys, "_part").orderBy(*order)
    return (
        ranged.withColumn("_local", F.row_number().over(inner).cast("long") - 1)
        .join(shifts, [*keys, "_part"])
        .withColumn(index, F.col("_local") + F.col("_shift"))
        .drop("_part", "_local", "_shift")
    )


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    columns: Sequence[str],
    back: int = 1,
    ahead: int = 1,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add ``c_p1..c_p<back>`` and ``c_n1..c_n<ahead>``: the values of the rows before and
    after. Only rows next to a chunk border are copied, so the shuffle grows by ~k/rows."""
    spread, w, home = _with_halo(df, keys, index, back, ahead, rows)
    added = {}
    for c in columns:
        for k in range(1, back + 1):
            added[f"{c}_p{k}"] = F.lag(c, k).over(w)
        for k in range(1, ahead + 1):
            added[f"{c}_n{k}"] = F.lead(c, k).over(w)
    return spread.withColumns(added).filter(home).drop("_chunk", "_home")


def _with_halo(df, keys, index, back, ahead, rows):
    """Rows copied to every chunk whose rows may look at them; window and home test. A
    sequence measured to be short is one chunk."""
    if is_small(df, index):
        one = df.withColumns({"_home": F.lit(0), "_chunk": F.lit(0)})
        return one, Window.partitionBy(*keys).orderBy(index), F.lit(True)
    if rows <= back + ahead:
        raise ValueError("chunk must be longer than the neighbourhood")
    i = F.col(index)
    at = F.pmod(i, F.lit(rows))
    inner = (at >= ahead) & (at < rows - back)
    targets = F.array_distinct(
        F.array(
            F.expr(f"greatest({index} - {ahead}L, 0L) div {rows}L"),
            F.col("_home"),
            F.expr(f"({index} + {back}L) div {rows}L"),
        )
    )
    spread = df.withColumn("_home", chunk_of(index, rows)).withColumn(
        "_chunk", F.explode(F.when(inner, F.array("_home")).otherwise(targets))
    )
    w = Window.partitionBy(*keys, "_chunk").orderBy(index)
    return spread, w, F.col("_chunk") == F.col("_home")


def over_frame(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    build,
    back: int,
    ahead: int,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add ``build(window)`` columns over the frame ``back`` rows before to ``ahead`` after."""
    rows = max(rows, 4 * (back + ahead + 1))
    spread, w, home = _with_halo(df, keys, index, back, ahead, rows)
    return spread.withColumns(build(w)).filter(home).drop("_chunk", "_home")


_KINDS = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}


def running(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    aggs: dict[str, tuple[str, Column]],
    reverse: bool = False,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Inclusive running aggregates along the sequence; kinds: sum, count, max, min, last.

    Chunk totals are one row per 65,536 inputs; their prefix is joined back by chunk, which
    has the same key as the inner window.
    """
    order = F.col(index).desc() if reverse else F.col(index)
    if is_small(df, index):
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns(
            {
                n: F.last(e, ignorenulls=True).over(w) if k == "last" else _KINDS[k](e).over(w)
                for n, (k, e) in aggs.items()
            }
        )
    # the rows are read twice below: freeze them, or chained calls would recompute 2^n times
    base = cut_lineage(df.withColumn("_chunk", chunk_of(index, rows)))
    key_chunk = [*keys, "_chunk"]
    inner = Window.partitionBy(*key_chunk).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    chunk_order = F.col("_chunk").desc() if reverse else F.col("_chunk")
    before = Window.partitionBy(*keys).orderBy(chunk_order).rowsBetween(Window.unboundedPreceding, -1)

    local, totals, carries, merged = {}, [], [], {}
    pick = F.min_by if reverse else F.max_by
    for name, (kind, expr) in aggs.items():
        part, carry = f"_w_{name}", f"_c_{name}"
        if kind == "last":
            local[part] = F.last(expr, ignorenulls=True).over(inner)
            totals.append(pick(expr, F.when(expr.isNotNull(), F.col(index))).alias(carry))
            carries.append(F.last(carry, ignorenulls=True).over(before).alias(carry))
            merged[name] = F.coalesce(F.col(part), F.col(carry))
            continue
        local[part] = _KINDS[kind](expr).over(inner)
        totals.append(_KINDS[kind](expr).alias(carry))
        fold = "sum" if kind in ("sum", "count") else kind
        carries.append(_KINDS[fold](carry).over(before).alias(carry))
        if fold == "sum":
            merged[name] = F.coalesce(F.col(part) + F.col(carry), F.col(part), F.col(carry))
        else:
            pick2 = F.greatest if kind == "max" else F.least
            merged[name] = pick2(F.col(part), F.col(carry))
    carried = base.groupBy(*key_chunk).agg(*totals).select(*key_chunk, *carries)
    return (
        base.withColumns(local)
        .join(carried, key_chunk, "left")
        .withColumns(merged)
        .drop("_chunk", *[f"_w_{n}" for n in aggs], *[f"_c_{n}" for n in aggs])
    )


def reindex(df: DataFrame, keys: Sequence[str], index: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """Close the gaps a filter left in a dense position, without a global sort.  Chunks are
    taken on the old position, so each still holds at most ``rows`` rows."""
    out = running(df, keys, index, {"_new": ("count", F.lit(1))}, rows=rows)
    return with_bound(out.withColumn(index, F.col("_new") - 1).drop("_new"), index, bound_of(df, index))


def islands(df, keys, index, start: Column, name: str = "island", rows: int = CHUNK_ROWS):
    """Number the stretches of a sequence; ``start`` is true on the first row of each."""
    flag = F.when(start, 1).otherwise(0)
    return running(df, keys, index, {name: ("sum", flag)}, rows=rows)
