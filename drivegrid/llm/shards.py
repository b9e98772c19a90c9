"""Contiguous shards whose largest is as small as possible.

Documents with equal texts are one atomic group. Groups stand in the order of their smallest
id, and a shard is a stretch of that order. The smallest feasible capacity is found by search:
a capacity is feasible if filling shards greedily up to it takes no more than ``shards`` of
them. Each pass checks ``width`` capacities at once (for each, the furthest group end within
reach is one maximum over all running totals), so a few passes settle it whatever the number
of groups. At that capacity each cut is put where the rest still fits and the shard comes
closest to an even share.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drivegrid.llm.common import null_empty, running_totals, written


class _Ends:
    """Questions about the running totals at group ends, each one distributed aggregation."""

    def __init__(self, ends: DataFrame):
        self._ends = ends

    def _ask(self, at: np.ndarray, floor: bool) -> np.ndarray:
        def run(batches):
            best = np.full(len(at), 0 if floor else np.iinfo(np.int64).max, dtype=np.int64)
            for pdf in batches:
                v = np.sort(pdf["total"].to_numpy())
                if not len(v):
                    continue
                if floor:
                    k = np.searchsorted(v, at, side="right") - 1
                    best = np.where(k >= 0, np.maximum(best, v[np.maximum(k, 0)]), best)
                else:
                    k = np.searchsorted(v, at, side="left")
                    best = np.where(k < len(v), np.minimum(best, v[np.minimum(k, len(v) - 1)]), best)
            yield pd.DataFrame({"k": np.arange(len(at)), "v": best})

        found = self._ends.mapInPandas(run, "k long, v long").groupBy("k").agg(F.max("v") if floor else F.min("v")).collect()
        out = np.zeros(len(at), dtype=np.int64)
        for k, v in found:  # one row per question
            out[k] = v
        return out

    def floor(self, at) -> np.ndarray:
        """The largest group end at or before each position (0 if none)."""
        return self._ask(np.asarray(at, dtype=np.int64), True)

    def ceil(self, at) -> np.ndarray:
        return self._ask(np.asarray(at, dtype=np.int64), False)


def smallest_capacity(ends: _Ends, total: int, largest: int, shards: int, width: int = 1024) -> int:
    """The smallest capacity at which greedy filling needs at most ``shards`` shards."""
    low, high = max(largest, -(-total // shards)), -(-total // shards) + largest
    while low < high:
        tried = np.unique(np.linspace(low, high - 1, min(width, high - low)).astype(np.int64))
        at = np.zeros(len(tried), dtype=np.int64)
        for _ in range(shards):
            at = ends.floor(np.minimum(at + tried, total))
        ok = np.flatnonzero(at >= total)
        if len(ok):
            high = int(tried[ok[0]])
            low = low if ok[0] == 0 else int(tried[ok[0] - 1]) + 1
        else:
            low = int(tried[-1]) + 1
    return high


def cut_points(ends: _Ends, total: int, capacity: int, shards: int) -> list[int]:
    """``shards - 1`` group ends; every stretch is at most ``capacity`` and near an even share."""
    latest_start = [total]
    for _ in range(shards - 1):  # where a shard must begin at the earliest for the rest to fit
        latest_start.append(int(ends.ceil([max(0, latest_start[-1] - capacity)])[0]) if latest_start[-1] > capacity else 0)
    earliest = latest_start[1:][::-1]
    cuts, at = [], 0
    for k in range(shards - 1):
        goal = at + (total - at) // (shards - k)
        below, reach = (int(v) for v in ends.floor([goal, min(at + capacity, total)]))
        above = int(ends.ceil([goal])[0])
        options = [v for v in (below, above) if max(at, earliest[k]) <= v <= reach]
        at = min(options, key=lambda v: abs(v - goal)) if options else min(max(below, earliest[k], at), reach)
        cuts.append(at)
    return cuts


def shard(df: DataFrame, shards: int = 8, row_id: str = "doc_id", text: str = "text", width: int = 1024) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``, one row per input row.

    Size is the UTF-8 length plus 1; a null text is an empty one. Rows with a null id come
    first in the order; repeated rows lie in one group and get slots of their own. Fewer
    groups than shards leave shards empty; an empty table gives no rows.
    """
    base = written(
        df.select(
            F.col(row_id).cast("long").alias("doc_id"),
            F.octet_length(null_empty(text)).cast("long").alias("bytes"),
            F.crc32(null_empty(text).cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(null_empty(text), 256)).alias("digest"),
        )
    )
    size = F.col("bytes") + 1
    groups = written(base.groupBy("digest").agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("first"), F.sum(size).alias("group_size")))
    total, largest = groups.agg(F.sum("group_size"), F.max("group_size")).first()
    law = F.lit("bytes").alias("law")
    if total is None:
        return base.select("doc_id", size.alias("size"), "text_crc32", law, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    ends = _Ends(written(running_totals(groups, ["first", "digest"], {"total": F.col("group_size")}).select("total")))
    cuts = cut_points(ends, total, smallest_capacity(ends, total, largest, shards, width), shards)
    members = base.join(groups.select("digest", "first"), "digest").select("first", "digest", "doc_id", "bytes", "text_crc32")
    rows = written(running_totals(members, ["first", "digest", "doc_id"], {"total": size, "nth": F.lit(1)}))
    number = sum((F.when(F.col("total") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    rows = rows.withColumn("shard", number.cast("int"))
    begins = rows.groupBy("shard").agg(F.min("nth").alias("begin"))  # at most ``shards`` rows
    return rows.join(F.broadcast(begins), "shard").select(
        "doc_id", size.alias("size"), "text_crc32", law, "shard", (F.col("nth") - F.col("begin")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
