"""Near-duplicate vectors by a pivot-permutation index.

A bounded sample of vectors serves as pivots. Every vector is described by its nearest pivots
in order, and stands in the inverted lists of the first ``prefix`` of them. How many that are is
measured: a sample of vectors, half of it from the longest lists, meets all rows in blocks, and
for every link found the shortest prefix is noted at which both ends share enough pivots. The
prefix that keeps the target share of links, over all of the sample and for those of the longest
lists alone, is used; where such lists would cost more than all pairs of a label, all pairs are
compared instead. Two vectors of one
label are candidates when they share at least ``min_shared`` of these pivots; they are counted
in the list of the first pivot they share and verified there by their cosine in double
precision. Equal vectors are one class from the start. A list longer than ``block_rows`` is cut
into blocks that meet pairwise, so a pivot near a third of all rows is many bounded tasks, and
only link counts and a spanning forest leave a task, never pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drivegrid.llm.common import components, written
from drivegrid.llm.jaccard_join import spanning

THRESHOLD = 0.93
#: Pivots: one for ``ROWS_PER_PIVOT`` distinct vectors, between the two bounds. The sample is
#: the whole fit; every row is indexed.
ROWS_PER_PIVOT, MIN_PIVOTS, MAX_PIVOTS = 128, 64, 4096
#: The shortest prefix; it grows until the measured recall is met.
PREFIX = 8
MIN_SHARED = 1
#: Share of the sampled links that the lists must keep, and how many vectors are sampled.
RECALL, SAMPLE = 0.99, 128
BLOCK_ROWS = 1024


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def choose_pivots(classes: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Pivots by dimension: the ``n`` vectors with the smallest hash of their id."""
    rows = classes.orderBy(F.xxhash64("node"), "node").limit(n).select("dim", "vector").collect()  # at most MAX_PIVOTS
    by_dim: dict[int, list] = {}
    for dim, v in rows:
        by_dim.setdefault(dim, []).append(v)
    return {d: _unit(np.array(v, dtype=np.float64)) for d, v in by_dim.items()}


def _index(classes: DataFrame, pivots: dict[int, np.ndarray], prefix: int) -> DataFrame:
    """``classes`` with the numbers of the nearest pivots, nearest first. A dimension without
    a pivot in the sample has one list of all its vectors."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)  # at most MAX_PIVOTS vectors

    def run(batches):
        table = shared.value
        for pdf in batches:
            near: list = [None] * len(pdf)
            dims = pdf["dim"].to_numpy()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                p = table.get(int(d))
                if p is None:
                    for k in at:
                        near[k] = [0]
                    continue
                x = _unit(np.stack(pdf["vector"].to_numpy()[at]).astype(np.float64))
                score = x @ p.T
                k = min(prefix, score.shape[1])
                top = np.argpartition(-score, k - 1, axis=1)[:, :k]
                order = np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable")
                for r, v in zip(at, np.take_along_axis(top, order, 1)):
                    near[r] = v.tolist()
            yield pdf.assign(pivots=near)

    return classes.mapInPandas(run, "node long, label string, dim int, vector array<double>, mult long, pivots array<int>")


def _sample(classes: DataFrame, pivots: dict[int, np.ndarray], n: int) -> list[tuple[int, str, int, list, bool]]:
    """(node, label, dimension, vector, dense): ``n`` vectors by the hash of their id, half of
    them from the longest lists of nearest pivots."""
    first = _index(classes, pivots, 1).withColumn("pivot", F.element_at("pivots", 1)).drop("pivots")
    first = written(first.select("node", "label", "dim", "pivot"))
    keys = ["label", "dim", "pivot"]
    longest = first.groupBy(*keys).agg(F.count("*").alias("c")).orderBy(F.desc("c"), *keys).limit(8)
    order = [F.xxhash64("node", F.lit(1)), "node"]
    chosen = first.select("node").orderBy(*order).limit(n // 2).withColumn("dense", F.lit(False))
    dense = first.join(F.broadcast(longest.select(*keys)), keys).select("node").orderBy(*order).limit(n - n // 2).withColumn("dense", F.lit(True))
    rows = classes.join(F.broadcast(chosen.unionByName(dense)), "node").select("node", "label", "dim", "vector", "dense").collect()  # at most ``n``
    return sorted((r[0], r[1], r[2], r[3], r[4]) for r in rows)


def measured_prefix(
    classes: DataFrame, pivots: dict[int, np.ndarray], threshold: float, min_shared: int, prefix: int, recall: float = RECALL, sample: int = SAMPLE,
) -> int:
    """The shortest prefix, at least ``prefix``, with which the lists keep the share ``recall``
    of the links between sampled vectors and all rows: over all links, over the links from the
    longest lists, and in the mean over the vectors of either kind."""
    queries = _sample(classes, pivots, sample)
    shared = classes.sparkSession.sparkContext.broadcast((queries, pivots))
    most = max((len(p) for p in pivots.values()), default=1)

    def run(batches):
        queries, table = shared.value
        by: dict[tuple, list[int]] = {}
        for k, (_, label, dim, _, _) in enumerate(queries):
            if dim in table:
                by.setdefault((label, dim), []).append(k)
        ready = {}
        for key, ks in by.items():
            x = _unit(np.array([queries[k][3] for k in ks], dtype=np.float64))
            ready[key] = ks, x, _ranks(x @ table[key[1]].T)
        total = np.zeros((len(queries), most + 1), dtype=np.int64)
        for pdf in batches:
            for key, at in pdf.groupby(["label", "dim"]).indices.items():
                if key not in ready:
                    continue
                ks, x, ranks = ready[key]
                enough = min(min_shared, ranks.shape[1])
                node = pdf["node"].to_numpy()[at]
                for block in range(0, len(at), 256):
                    here = at[block:block + 256]
                    y = _unit(np.stack(pdf["vector"].to_numpy()[here]).astype(np.float64))
                    hit = y @ x.T >= threshold
                    rows = np.flatnonzero(hit.any(1))
                    own = _ranks(y[rows] @ table[key[1]].T)
                    for r, mine in zip(rows, own):
                        for q in np.flatnonzero(hit[r]):
                            if node[block + r] != queries[ks[q]][0]:
                                need = np.partition(np.maximum(mine, ranks[q]), enough - 1)[enough - 1] + 1
                                total[ks[q], need] += 1
        q, need = np.nonzero(total)
        yield pd.DataFrame({"q": q, "need": need, "n": total[q, need]})

    found = classes.select("node", "label", "dim", "vector").mapInPandas(run, "q int, need int, n long").groupBy("q", "need").agg(F.sum("n").alias("n")).toPandas()  # SAMPLE * MAX_PIVOTS at most
    links = np.zeros((len(queries), most + 1))
    links[found["q"], found["need"]] = found["n"]
    dense = np.array([r[4] for r in queries], dtype=bool)
    for part in (links, links[dense], links[~dense]):
        part = part[part.sum(1) > 0]
        if len(part):
            for share in (part.sum(0).cumsum() / part.sum(), (part.cumsum(1) / part.sum(1, keepdims=True)).mean(0)):
                prefix = max(prefix, int(np.argmax(share >= recall - 1e-12)))
    return prefix


def _ranks(score: np.ndarray) -> np.ndarray:
    """Place of each pivot in the order of nearness, nearest first."""
    order = np.argsort(-score, axis=1, kind="stable")
    out = np.empty(order.shape, dtype=np.int32)
    np.put_along_axis(out, order, np.arange(order.shape[1], dtype=np.int32)[None, :], 1)
    return out


def _verify(threshold: float, min_shared: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pivot, one, two = int(key[2]), int(key[3]), int(key[4])
        pdf = pdf.sort_values("node")
        block = pdf["block"].to_numpy()
        left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
        x = _unit(np.stack(pdf["vector"].to_numpy()).astype(np.float64))
        cosine = x[left] @ x[right].T
        hit = cosine >= threshold
        if one == two:
            hit = np.triu(hit, 1)
        i, j = np.nonzero(hit)
        a, b = left[i], right[j]
        # how many pivots two vectors share, and whether one of them comes before this list's
        near = pdf["pivots"].tolist()
        used, number = np.unique(np.concatenate(near), return_inverse=True)
        stands = np.zeros((len(pdf), len(used)), dtype=np.float32)
        stands[np.repeat(np.arange(len(pdf)), list(map(len, near))), number] = 1.0
        before = stands[:, used < pivot]
        keep = (before[left] @ before[right].T == 0)[i, j]
        if min_shared > 1:
            keep &= (stands[left] @ stands[right].T >= min_shared)[i, j]
        a, b = a[keep], b[keep]
        mult, node = pdf["mult"].to_numpy(), pdf["node"].to_numpy()
        links = np.bincount(a, mult[b], len(pdf)) + np.bincount(b, mult[a], len(pdf))
        top = spanning(len(pdf), a, b)
        out = np.flatnonzero(links > 0)
        return pd.DataFrame({"node": node[out], "top": node[top[out]], "links": links[out].astype(np.int64)})

    return run


def link_vectors(
    df: DataFrame, row_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD,
    prefix: int = PREFIX, min_shared: int = MIN_SHARED, block_rows: int = BLOCK_ROWS, pivots: int | None = None,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per input row.

    Vectors are compared when their labels are equal and not null and their lengths agree.
    Vectors that are null, empty, zero or hold a null or non-finite component link with
    nothing, nor do rows with a null id (kept, with a null component). Repeated rows link with
    each other; an id that repeats with different vectors is one node. An empty table gives no
    rows; further columns are ignored.
    """
    double = F.col(vector).cast("array<double>")
    good = F.size(double) > 0
    good &= F.forall(double, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    good &= F.exists(double, lambda v: v != 0.0)
    rows = df.select(F.col(row_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), double.alias("vector"), F.coalesce(good, F.lit(False)).alias("good"))
    usable = rows.filter("good AND label IS NOT NULL AND vec_id IS NOT NULL").drop("good")
    # every length is scaled to at most 1, so that no square overflows
    usable = usable.withColumn("vector", F.expr("transform(vector, v -> v / array_max(transform(vector, w -> abs(w))))"))
    classes = usable.groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("mult"))
    classes = written(classes.select("node", "label", F.size("vector").alias("dim"), "vector", "mult"))
    n = classes.count()
    wanted = pivots or min(MAX_PIVOTS, max(MIN_PIVOTS, n // ROWS_PER_PIVOT))
    chosen = choose_pivots(classes, wanted)
    prefix = measured_prefix(classes, chosen, threshold, min_shared, prefix)
    per = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0.0
    indexed = written(_index(classes, chosen, prefix))
    sizes = indexed.select("label", "dim", F.explode("pivots").alias("pivot")).groupBy("label", "dim", "pivot").agg(F.count("*").alias("n"))
    if (sizes.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0.0) > per:
        indexed = indexed.withColumn("pivots", F.array(F.lit(0)))  # one list a label: all pairs
        min_shared = 1
    lists = indexed.withColumn("pivot", F.explode("pivots"))
    keys = ["label", "dim", "pivot"]
    sizes = lists.groupBy(*keys).agg(F.count("*").alias("c")).filter("c > 1").withColumn("blocks", F.ceil(F.col("c") / F.lit(block_rows)))
    placed = lists.join(sizes.drop("c"), keys).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    partner = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    placed = placed.withColumn("other", partner).withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")})
    placed = placed.select(*keys, "one", "two", "node", "vector", "mult", "pivots", "block")
    checked = written(placed.groupBy(*keys, "one", "two").applyInPandas(_verify(threshold, min_shared), "node long, top long, links long"))
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(checked, "node", "top")
    known = links.join(comp, "node", "left").withColumnRenamed("node", "_n")
    per_class = classes.select("label", "vector", "mult", "node").join(known, F.col("node") == F.col("_n"), "left")
    per_class = per_class.select("label", "vector", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "node").alias("component"))
    linked = usable.join(written(per_class), ["label", "vector"], "left").select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.filter("NOT good OR label IS NULL OR vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
