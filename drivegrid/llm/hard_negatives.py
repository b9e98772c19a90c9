"""Hard negatives by an exact matrix product in a residue number system.

Vectors become integers (``floor(scale * x)``). Their inner products are computed exactly by
ordinary float32 matrix products: the components are reduced modulo several small primes, each
product is taken modulo its prime (in slices of components short enough that no float32 sum
passes 2**24), and the signed score is put together again by Chinese remaindering. How many
primes are needed follows from the norms in a pair of blocks (Cauchy-Schwarz).

The work is spread as pairs of blocks, anchors against rows. Two passes: the first finds each
anchor's positives, the second the negatives inside every positive's score window. A task
returns at most ``k`` rows for each anchor (and positive) of its block; windows combine them.
"""

from __future__ import annotations

from math import isqrt, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from drivegrid.llm.common import written

#: Largest prime in use: residues within +-254, so 260 components fit one float32 product.
TOP_PRIME = 509
#: Scores beyond this would not leave room for the window's factors in 64 bits.
MOST_SCORE = 1 << 55
#: Scores of one slice of anchors that a task holds at once.
SLICE_SCORES = 1 << 21
#: Rows of a block: a 32nd of the table, within these bounds (components for the upper one).
LEAST_ROWS, MOST_CELLS = 2048, 1 << 24

_IDLE = np.iinfo(np.int64).min


def primes_down(top: int = TOP_PRIME, least: int = 256) -> list[int]:
    return [p for p in range(top, least, -1) if all(p % q for q in range(2, isqrt(p) + 1))]


def moduli_for(bound: int) -> list[int]:
    """The primes whose product tells all scores within ``+-bound`` apart."""
    chosen = []
    for p in primes_down():
        if prod(chosen) > 2 * bound:
            return chosen
        chosen.append(p)
    raise ValueError(f"scores up to {bound} are out of range")


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of integer matrices, exact, as int64."""
    norms = [max((sum(int(x) * int(x) for x in row) for row in m[np.argsort(-(m.astype(np.float64) ** 2).sum(1))[:4]]), default=0) for m in (a, b)]
    # the float order of the norms is exact to about 1 in 2**50, the few largest are exact
    bound = isqrt(norms[0] * norms[1]) + 1 + isqrt(norms[0] * norms[1]) // (1 << 40)
    if bound > MOST_SCORE:
        raise ValueError(f"scores up to {bound} are out of range")
    value, base = None, 1
    for p in moduli_for(bound):
        r = _modular(a, b, p)
        if value is None:
            value = r
        else:  # mixed radix: add the multiple of the base that gives the next remainder
            value += base * ((r - value) * pow(base, -1, p) % p)
        base *= p
    value[value > base // 2] -= base
    return value


def _modular(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    half = p // 2
    ra, rb = (((m + half) % p - half).astype(np.float32) for m in (a, b))
    step = (1 << 24) // (half * half)
    total = np.zeros((len(a), len(b)), dtype=np.int64)
    for k in range(0, a.shape[1], step):
        total += (ra[:, k:k + step] @ rb[:, k:k + step].T).astype(np.int64)
    return total % p


def best_per_row(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the ``k`` highest scores a row; ties by smaller column.
    Entries of ``_IDLE`` do not count."""
    if scores.shape[1] > k:
        floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
        r, c = np.nonzero((scores >= floor) & (scores != _IDLE))
    else:
        r, c = np.nonzero(scores != _IDLE)
    order = np.lexsort((c, -scores[r, c], r))
    r, c = r[order], c[order]
    first = np.searchsorted(r, r)  # where the row's entries begin
    keep = np.arange(len(r)) - first < k
    return r[keep], c[keep]


def _matrix(vectors: pa.ChunkedArray, width: int, scale: int) -> np.ndarray:
    """Integer rows of ``width`` components; shorter vectors are filled up with zeros."""
    flat = vectors.combine_chunks()
    offsets = flat.offsets.to_numpy()
    sizes = np.diff(offsets)
    values = flat.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]].astype(np.float64)
    scaled = np.floor(values * scale)
    if np.abs(scaled).max(initial=0) > 2.0**53:
        raise ValueError("a scaled component is out of range")
    out = np.zeros((len(sizes), width), dtype=np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = scaled.astype(np.int64)
    return out


def _sides(anchors: pa.Table, rows: pa.Table, scale: int):
    """Both blocks as (ids, labels, matrix), the rows by id; labels as joint numbers."""
    rows = rows.sort_by("vec_id")
    width = max((int(np.diff(t["vec"].combine_chunks().offsets.to_numpy()).max(initial=0)) for t in (anchors, rows)), default=0)
    ids = [t["vec_id"].to_numpy() for t in (anchors, rows)]
    labels = np.unique(np.concatenate([t["label"].to_numpy() for t in (anchors, rows)]), return_inverse=True)[1]
    cut = len(ids[0])
    return (ids[0], labels[:cut], _matrix(anchors["vec"], width, scale)), (ids[1], labels[cut:], _matrix(rows["vec"], width, scale))


def _block_rows(n: int, width: int) -> int:
    return max(1, min(max(n // 32, LEAST_ROWS), MOST_CELLS // max(width, 1)))


def _eligible(df: DataFrame, row_id: str, vector: str, label: Column) -> DataFrame:
    x = F.col(vector).cast("array<double>")
    fine = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = df.select(F.col(row_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector).alias("vec"), fine.alias("fine"))
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL AND fine").drop("fine")
    twice = written(rows.groupBy("vec_id").agg(F.count("*").alias("n")).filter("n > 1").select("vec_id"))
    if twice.isEmpty():  # ids only have been read; vectors stay where they are
        return rows
    first = rows.join(twice, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("one"))
    return rows.join(twice, "vec_id", "left_anti").unionByName(first.select("vec_id", "one.label", "one.vec"))


def mine(
    df: DataFrame, anchors: Column, label: Column, row_id: str = "vec_id", vector: str = "embedding", scale: int = 256,
    positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), block_rows: int | None = None,
) -> DataFrame:
    """For each anchor and each of its positives the highest negatives inside the window:
    ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` is a condition on ``row_id``; ``label`` an integral column. Positives are the
    first other rows of the label by score, ties by smaller id; negatives rows of other labels
    with ``window[0] * positive <= 100 * negative <= window[1] * positive``. Pairs without a
    negative give no row.

    Rows with a null id, label or vector, or a null or non-finite component, take no part.
    Rows that repeat an id count once, as the one with the smallest label, then vector.
    Vectors of other lengths are compared as if filled up with zeros. Scores beyond 2**55 are
    an error. An empty table gives no rows; further columns are ignored.
    """
    rows = _eligible(df, row_id, vector, label)
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width"), F.count(F.when(anchors, 1)).alias("anchors")).head()
    per = block_rows or _block_rows(size["n"], size["width"] or 0)
    n_rows, n_anchors = -(-size["n"] // per) or 1, -(-size["anchors"] // per) or 1

    def block(n: int) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")

    def everywhere(n: int, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    dealt = rows.select("*", block(n_rows).alias("b")).select("*", everywhere(n_anchors, "a"))
    asking = rows.filter(anchors).select(*[F.col(c).alias(c) for c in rows.columns])

    def found(anchor_rows: DataFrame, select, schema: str) -> DataFrame:
        spread = anchor_rows.select("*", block(n_anchors).alias("a")).select("*", everywhere(n_rows, "b"))
        return spread.groupBy("a", "b").cogroup(dealt.groupBy("a", "b")).applyInArrow(select, schema)

    def near(anchor_block: pa.Table, row_block: pa.Table) -> pa.Table:
        (ids, labels, q), (other, other_labels, m) = _sides(anchor_block, row_block, scale)
        out = []
        for at in _slices(len(ids), len(other)):
            s = exact_products(q[at], m)
            s[(labels[at][:, None] != other_labels) | (ids[at][:, None] == other)] = _IDLE
            r, c = best_per_row(s, positives)
            out.append((ids[at][r], other[c], s[r, c]))
        return _table(out, ["vec_id", "positive_id", "positive_score"])

    def far(anchor_block: pa.Table, row_block: pa.Table) -> pa.Table:
        (ids, labels, q), (other, other_labels, m) = _sides(anchor_block, row_block, scale)
        wanted = anchor_block["positives"].combine_chunks()
        bounds, pairs = wanted.offsets.to_numpy(), wanted.values
        bounds = bounds - bounds[0] if len(bounds) else bounds
        pid, pscore = (pairs.field(f).to_numpy() for f in ("positive_id", "positive_score"))
        out = []
        for at in _slices(len(ids), len(other) * positives):
            s = exact_products(q[at], m)
            s[labels[at][:, None] == other_labels] = _IDLE
            span = np.arange(bounds[at.start], bounds[at.stop])
            mine_of = np.repeat(np.arange(at.stop - at.start), np.diff(bounds[at.start:at.stop + 1]))
            w, p = s[mine_of], pscore[span][:, None]
            # 100 * score may pass 64 bits for idle entries, so these are compared by the bounds
            w[(w < -(-window[0] * p // 100)) | (w > window[1] * p // 100)] = _IDLE
            r, c = best_per_row(w, negatives)
            out.append((ids[at][mine_of[r]], pid[span][r], other[c], pscore[span][r], w[r, c]))
        return _table(out, ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    def first(found_rows: DataFrame, keys: list[str], score: str, row: str, k: int) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc(score), row)
        return found_rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    top = first(found(asking, near, "vec_id long, positive_id long, positive_score long"), ["vec_id"], "positive_score", "positive_id", positives)
    wanted = written(top.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("positive_id", "positive_score"))).alias("positives")))
    hard = found(
        asking.join(wanted, "vec_id"), far, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    )
    return first(hard, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def _slices(n: int, scores_each: int):
    step = max(1, SLICE_SCORES // max(scores_each, 1))
    return [slice(k, min(k + step, n)) for k in range(0, n, step)]


def _table(parts: list[tuple], names: list[str]) -> pa.Table:
    columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(len(names))]
    return pa.table({name: c.astype(np.int64) for name, c in zip(names, columns)})
