"""Best-fit packing of tokenised documents into sequences by exact-complement hashing.

Pieces shorter than a sequence are described by a histogram of lengths, at most ``capacity``
numbers however many rows there are. The plan is made on that histogram: the longest length is
taken together with one, two or three other lengths that fill its gap exactly, found in an
index of single, pair and triple sums, as often as the counts allow; what has no exact
complement is packed best-fit, longest first, into the gaps left. A plan entry says "this
combination, so many times", so the plan's size depends on ``capacity`` alone. In Spark the
pieces of one length are then numbered (salted, a length may hold a third of all rows) and
each number finds its sequence and offset in the plan.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from drivegrid.llm.common import null_empty, written

CAPACITY = 2048
_CACHE_WORDS = 400_000
#: Where a chunk cannot be encoded alone: a space before other white space or at the end.
_LOOSE = re.compile(r" (?:\s|$)")
_ENCODERS: dict[str, "Encoder"] = {}


class Encoder(dict):
    """Token ids (little-endian uint32 bytes) of a byte-level BPE vocabulary, with a bounded
    cache of space-separated chunks: the vocabulary's own pattern always splits before a space
    that is followed by a word, so chunks can be encoded one by one. Texts are first cut at the
    added tokens of the vocabulary's JSON form (of several at one place the longest), which have
    ids of their own; no chunk goes across one."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._raw = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        with open(public_tokenizers.path(vocabulary.removesuffix(".tiktoken") + ".json"), encoding="utf-8") as f:
            found = json.load(f)["added_tokens"]
        self._added = {t["content"]: np.array([t["id"]], dtype="<u4").tobytes() for t in found}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")") if found else None

    def whole(self, text: str) -> bytes:
        return np.array(self._raw.encode_ordinary(text), dtype="<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        ids = self[chunk] = self.whole(" " + chunk)
        return ids

    def encode(self, text: str) -> bytes:
        if self._cut is None or not self._cut.search(text):
            return self._plain(text)
        return b"".join(self._added[t] if k % 2 else self._plain(t) for k, t in enumerate(self._cut.split(text)))

    def _plain(self, text: str) -> bytes:
        if _LOOSE.search(text):
            return self.whole(text)
        head, *rest = text.split(" ")
        return (self.whole(head) if head else b"") + b"".join(map(self.__getitem__, rest))


def encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def cut_pieces(ids: bytes, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: only the first may be shorter than ``capacity``."""
    n = len(ids) // 4
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(df: DataFrame, row_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k.tiktoken", end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: every document's ids, then ``end_id``, cut."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        enc = encoder(vocabulary)
        for pdf in batches:
            rows = []
            for doc, t in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
                ids = enc.encode(t) + end
                doc = None if doc is None or doc != doc else int(doc)
                for k, (start, length) in enumerate(cut_pieces(ids, capacity)):
                    rows.append((doc, k, start, length, zlib.crc32(ids[4 * start:4 * (start + length)])))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    return df.select(F.col(row_id).cast("long").alias("doc_id"), null_empty(text).alias("text")).mapInPandas(run, _PIECE)


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of one sequence, how many such sequences)] for pieces of the given counts."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    plan: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        plan.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    rest: dict[int, int] = {}
    for length in range(capacity - 1, 0, -1):
        while left[length]:
            others = _complement(left, length, capacity - length)
            if others is None:
                rest[length] = int(left[length])
                left[length] = 0
                break
            need = Counter((length, *others))
            times = min(int(left[k]) // c for k, c in need.items())
            for k, c in need.items():
                left[k] -= c * times
            plan.append(((length, *others), times))
    return plan + _best_fit(rest, capacity)


def _complement(left: np.ndarray, length: int, gap: int) -> tuple[int, ...] | None:
    """One, two or three lengths with the exact sum ``gap``, all still available beside
    ``length``; larger parts first, so that short pieces stay for later gaps."""
    free = left[:gap + 1].copy()
    if length <= gap:
        free[length] -= 1
    has = free > 0
    if has[gap]:
        return (gap,)
    pair = _pair(free, has, gap)
    if pair:
        return pair
    for a in np.flatnonzero(has[:gap - 1])[::-1]:
        if 3 * a < gap:
            break
        free[a] -= 1
        was, has[a] = has[a], free[a] > 0
        pair = _pair(free, has, gap - a, top=a)
        free[a] += 1
        has[a] = was
        if pair:
            return (int(a), *pair)
    return None


def _pair(free: np.ndarray, has: np.ndarray, total: int, top: int | None = None) -> tuple[int, int] | None:
    """The largest available a with a + b = total, b <= a (and a <= ``top``)."""
    low = (total + 1) // 2
    high = total - 1 if top is None else min(top, total - 1)
    if high < low:
        return None
    both = has[low:high + 1] & has[total - high:total - low + 1][::-1]
    if total % 2 == 0 and both[0] and free[low] < 2:
        both = both.copy()
        both[0] = False
    hits = np.flatnonzero(both)
    if not len(hits):
        return None
    a = low + int(hits[-1])
    return a, total - a


def _best_fit(rest: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: equal open sequences are placed together."""
    by_gap: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            gap = min((g for g, v in by_gap.items() if g >= length and v), default=None)
            if gap is None:
                fit = capacity // length
                whole, over = divmod(n, fit)
                for k, times in ((fit, whole), (over, 1)):
                    if k and times:
                        home = by_gap[capacity - k * length]
                        key = (length,) * k
                        home[key] = home.get(key, 0) + times
                break
            key, times = by_gap[gap].popitem()
            fit = min(gap // length, n)
            whole = min(times, n // fit)
            if times > whole:
                by_gap[gap][key] = times - whole
            grown, home = key + (length,) * fit, by_gap[gap - fit * length]
            home[grown] = home.get(grown, 0) + whole
            n -= whole * fit
    return [(key, times) for v in by_gap.values() for key, times in v.items()]


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, dict[str, np.ndarray]]:
    """For each length: from which number on (``rank``) its pieces fill which combination."""
    used: Counter = Counter()
    out: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    first = 0
    for key, times in plan:
        at = 0
        for length, c in sorted(Counter(key).items(), reverse=True):
            out[length].append((used[length], first, c, at))
            used[length] += c * times
            at += c * length
        first += times
    return {k: dict(zip(("rank", "first", "per", "at"), np.array(v, dtype=np.int64).T)) for k, v in out.items()}


def pack(df: DataFrame, row_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k.tiktoken", end_id: int = 0, salt_rows: int = 100_000) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is the single ``end_id``; null and repeated ids are packed like any
    other row (rows equal in every column are interchangeable). An empty table gives no rows.
    """
    cut = written(pieces(df, row_id, text, capacity, vocabulary, end_id))
    total = cut.count()
    salts = max(64, -(-total // salt_rows))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    per = written(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    histogram = {int(r[0]): int(r[1]) for r in per.groupBy("length").agg(F.sum("n")).collect()}  # at most ``capacity`` rows
    slots = df.sparkSession.sparkContext.broadcast(_slots(plan_packing(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = per.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inner = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("local", F.row_number().over(inner) - 1).join(shift, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("local") + F.col("shift")).cast("long").alias("rank"))

    def place(batches):
        table = slots.value
        for pdf in batches:
            seq, off = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
            length, rank = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            for n in np.unique(length):
                here = np.flatnonzero(length == n)
                s, r = table[int(n)], rank[here]
                k = np.searchsorted(s["rank"], r, side="right") - 1
                along = r - s["rank"][k]
                seq[here] = s["first"][k] + along // s["per"][k]
                off[here] = s["at"][k] + (along % s["per"][k]) * n
            yield pdf.drop(columns="rank").assign(sequence_id=seq, offset=off).astype({"doc_id": "Int64"})

    return ranked.mapInPandas(place, _PIECE + ", sequence_id long, offset long")
