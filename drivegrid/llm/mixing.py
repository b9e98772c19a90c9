"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a share of all words by weight, at most ``most`` times its own size; what is
above is shared again among the others. A document should then be taken r = target / size of
its source times: floor(r) whole copies and one more with probability p = r - floor(r).

The probabilities of one source are rounded together. The two sides of a pair exchange
probability mass, measured in words, until one of them reaches 0 or 1: the expected copies of
each stay r, and the words taken by the pair do not change. Pairs are formed inside small
buckets of a source, larger documents first. In a bucket all probabilities are still equal, so
a document is paired with the pool of all smaller ones, which keeps one common probability;
the document left open is then a small one. These residuals are combined, two by two, in a
reduction tree of ``fan_in`` buckets a node, so a source with a third of all rows is spread
over many tasks, and at the root one document per source is rounded by a coin.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drivegrid.lib.ordered import index_rows
from drivegrid.llm.common import free_names, null_empty, written

WEIGHTS = (1.0, 2.0, 3.0)
BUCKET_ROWS = 2048
FAN_IN = 256
_UNIT = "src long, doc_id long, size long, weight double, base long, p double, copies long, bucket long"


def word_count(text: str) -> Column:
    """Words are runs of anything but ASCII white space; null has none."""
    return F.regexp_count(null_empty(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: float = 3.0) -> DataFrame:
    """``src, source, n_rows, source_size, target`` from rows of ``source, size``.

    Sources are numbered by code point, null last, and weigh ``weights`` in turn. Shares above
    ``most`` times a source's size are cut there and the rest is shared again by weight until
    none is above; each round is one aggregation and cuts at least one source.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    per = per.withColumns({"_null": F.col("source").isNull(), "_key": null_empty("source")})
    per = index_rows(written(per), [], ["_null", "_key"], index="src")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("src", F.lit(len(weights))) + 1).cast("int"))
    per = written(per.select("src", "source", "n_rows", "source_size", turn.alias("w")))
    ceiling = F.col("source_size") * F.lit(float(most))
    level, total = -1.0, per.agg(F.sum("source_size")).first()[0] or 0
    while True:
        above = F.col("w") * level > ceiling if level >= 0 else F.lit(False)
        used, free = per.agg(F.coalesce(F.sum(F.when(above, ceiling)), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("w"))), F.lit(0.0))).first()
        new = (total - used) / free if free > 0 else level
        if new <= level + 1e-12 * abs(level):
            break
        level = new
    return per.select("src", "source", "n_rows", "source_size", F.least(F.col("w") * F.lit(max(level, 0.0)), ceiling).alias("target"))


def _uniform(seed: int, level: int, src: int, bucket: int) -> np.random.Generator:
    return np.random.default_rng([seed, level, src, bucket])


def round_bucket(weight: np.ndarray, p: np.ndarray, rng: np.random.Generator, last: bool) -> np.ndarray:
    """Probabilities after pairing all open rows in order; with ``last`` none stays open."""
    p = p.copy()
    free = weight <= 0
    p[free] = rng.random(int(free.sum())) < p[free]
    draws = rng.random(len(p) + 1)
    todo = np.flatnonzero((p > 0.0) & (p < 1.0))
    if len(todo) > 1 and np.ptp(p[todo]) == 0.0:
        _round_with_pool(weight, p, todo, draws)
    held = -1
    for j in range(len(p)):
        if not 0.0 < p[j] < 1.0:
            continue
        if held < 0:
            held = j
            continue
        a, b, pa, pb = weight[held], weight[j], p[held], p[j]
        give = min(a * pa, b * (1.0 - pb))  # words from the held row to row j
        take = min(a * (1.0 - pa), b * pb)
        if draws[j] * (give + take) < take:
            pa, pb = pa - give / a, pb + give / b
            done_a, done_b = give == a * p[held], give == b * (1.0 - p[j])
            pa, pb = 0.0 if done_a else pa, 1.0 if done_b else pb
        else:
            pa, pb = pa + take / a, pb - take / b
            done_a, done_b = take == a * (1.0 - p[held]), take == b * p[j]
            pa, pb = 1.0 if done_a else pa, 0.0 if done_b else pb
        p[held], p[j] = pa, pb
        open_a, open_b = 0.0 < pa < 1.0, 0.0 < pb < 1.0
        held = held if open_a else j if open_b else -1
    if last and held >= 0:
        p[held] = float(draws[-1] < p[held])
    return p


def _round_with_pool(weight: np.ndarray, p: np.ndarray, todo: np.ndarray, draws: np.ndarray) -> None:
    """Pair each row with the pool of the later ones, which share the probability ``q``."""
    q = float(p[todo[0]])
    after = np.append(np.cumsum(weight[todo][::-1])[::-1][1:], 0.0)
    for at, (j, pool) in enumerate(zip(todo, after)):
        a = weight[j]
        if pool <= 0.0:
            p[j] = q
            return
        give, take = min(a * q, pool * (1.0 - q)), min(a * (1.0 - q), pool * q)
        if draws[j] * (give + take) < take:
            p[j] = 0.0 if give == a * q else q - give / a
            q = 1.0 if give == pool * (1.0 - q) else q + give / pool
        else:
            p[j] = 1.0 if take == a * (1.0 - q) else q + take / a
            q = 0.0 if take == pool * q else q - take / pool
        if not 0.0 < q < 1.0:
            p[todo[at + 1:]] = q
            return


def _rounder(level: int, last: bool, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "doc_id", "size"], ascending=[False, True, True], kind="stable")
        rng = _uniform(seed, level, int(pdf.src.iloc[0]), int(pdf.bucket.iloc[0]))
        p = round_bucket(pdf.weight.to_numpy(float), pdf.p.to_numpy(float), rng, last)
        closed = (p == 0.0) | (p == 1.0)
        copies = pd.array(np.where(closed, pdf.base.to_numpy() + p, 0).astype("int64"), dtype="Int64")
        copies[~closed] = pd.NA
        return pdf.assign(p=p, copies=copies)

    return run


def mix(
    df: DataFrame, row_id: str = "doc_id", source: str = "source", size: Column | None = None, text: str = "text",
    weights=WEIGHTS, most: float = 3.0, seed: int = 20260, bucket_rows: int = BUCKET_ROWS, fan_in: int = FAN_IN,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies``: one row per distinct
    (doc_id, source, size), with the number of its repeats as ``n_rows``.

    Rows repeated in all three are one unit and share its copies. Null ids are allowed and
    form units of their own; a null source is a source; a null text has size 0, and documents
    of size 0 add nothing whatever their copies. An empty table gives no rows. The same rows,
    weights and seed give the same copies, whatever the layout.
    """
    rows = df.select(F.col(row_id).cast("long").alias("doc_id"), F.col(source).alias("source"), (word_count(text) if size is None else size).cast("long").alias("size"))
    units = written(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n_rows")))
    # sizes count repeats, so the totals take them as mass
    per = written(source_targets(units.select("source", (F.col("size") * F.col("n_rows")).alias("size")), weights, most))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    buckets = F.ceil(F.col("s.n_rows") / F.lit(bucket_rows))
    joined = units.alias("u").join(per.alias("s"), F.col("u.source").eqNullSafe(F.col("s.source")))
    todo = joined.select(
        "src", "doc_id", "size", (F.col("size") * F.col("u.n_rows")).cast("double").alias("weight"), F.floor(rate).alias("base"),
        (rate - F.floor(rate)).alias("p"), F.lit(None).cast("long").alias("copies"),
        F.pmod(F.xxhash64("doc_id", "size"), buckets).alias("bucket"),
    )
    width = per.agg(F.max(F.ceil(F.col("n_rows") / F.lit(bucket_rows)))).first()[0] or 1
    done, level = [], 0
    while True:
        last = width <= 1
        step = written(todo.groupBy("src", "bucket").applyInPandas(_rounder(level, last, seed), _UNIT))
        done.append(step.filter("copies IS NOT NULL"))
        if last:
            break
        width, level = -(-width // fan_in), level + 1
        todo = step.filter("copies IS NULL").withColumn("bucket", F.expr(f"bucket div {fan_in}L"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    sources = per.select("src", "source", "source_size", "target")
    counted = units.select("doc_id", F.col("source").alias("_s"), "size", "n_rows")
    out = out.join(sources, "src").select("doc_id", "source", "size", "source_size", "target", "copies")
    return out.join(
        counted, out["doc_id"].eqNullSafe(counted["doc_id"]) & (out["size"] == counted["size"]) & out["source"].eqNullSafe(counted["_s"])
    ).select(out["doc_id"], "source", out["size"], "source_size", "target", "copies", "n_rows")


def mixed(df: DataFrame, row_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The rows of ``df``, each repeated as often as the mix takes it."""
    id_, src, size, copies, words, nth = free_names(df, "_id", "_source", "_size", "_copies", "_words", "_nth")
    plan = mix(df, row_id, source, text=text, **options).filter("copies > 0").select(
        F.col("doc_id").alias(id_), F.col("source").alias(src), F.col("size").alias(size), F.col("copies").alias(copies)
    )
    same = F.col(row_id).eqNullSafe(F.col(id_)) & F.col(source).eqNullSafe(F.col(src)) & (F.col(words) == F.col(size))
    return (
        df.withColumn(words, word_count(text)).join(plan, same)
        .withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
        .select(*df.columns)
    )
