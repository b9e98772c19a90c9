"""Hard negatives: exact products and whole results against brute force."""

from math import inf, nan

import numpy as np
import pytest
from pyspark.sql import functions as F

from drivegrid.llm import hard_negatives as hn


@pytest.mark.parametrize("top, width", [(300, 64), (40_000, 700), (2**22, 5), (0, 3), (5, 0)])
def test_products_are_exact(top, width):
    rng = np.random.default_rng(top + width)
    a, b = (rng.integers(-top, top + 1, (k, width)) for k in (7, 11))
    assert (hn.exact_products(a, b) == (a.astype(object) @ b.T.astype(object)).astype(np.int64)).all()


def test_scores_out_of_range_are_refused():
    with pytest.raises(ValueError):
        hn.exact_products(np.full((1, 8), 2**40), np.full((1, 8), 2**40))


def test_best_per_row_breaks_ties_by_column():
    rng = np.random.default_rng(3)
    s = rng.integers(0, 4, (30, 50))
    s[rng.random(s.shape) < 0.4] = hn._IDLE
    s[4] = hn._IDLE
    r, c = hn.best_per_row(s, 6)
    for k in range(30):
        want = sorted((-v, j) for j, v in enumerate(s[k]) if v != hn._IDLE)[:6]
        assert [(-s[k, j], j) for j in c[r == k]] == want


def brute(rows, every=100, positives=5, negatives=10):
    seen = {}
    for i, vec, label in rows:
        if i is None or label is None or vec is None or any(x is None or x != x or abs(x) == inf for x in vec):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        seen[i] = min(seen.get(i, (label, vec)), (label, vec))
    q = {i: [int(np.floor(256 * float(np.float32(x)))) for x in vec] for i, (_, vec) in seen.items()}
    out = set()
    for a in (i for i in seen if i % every == 0):
        score = {i: sum(x * y for x, y in zip(q[a], q[i])) for i in seen if i != a}
        first = sorted((i for i in score if seen[i][0] == seen[a][0]), key=lambda i: (-score[i], i))[:positives]
        for p in first:
            fits = [i for i in score if seen[i][0] != seen[a][0] and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            for k, i in enumerate(sorted(fits, key=lambda i: (-score[i], i))[:negatives]):
                out.add((a, p, k + 1, i, score[p], score[i]))
    return out


def mined(df, **more):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = [tuple(r) for r in hn.mine(df, F.col("vec_id") % 100 == 0, label, **more).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("block_rows", [None, 150, 37])
def test_table_matches_brute_force(spark, block_rows):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    assert mined(df, block_rows=block_rows) == brute(rows)


SCHEMA = "vec_id long, embedding array<float>, label int, b int, a string, fine int, n long, rank string, positives int, vec string"


@pytest.mark.parametrize("block_rows", [None, 20])
def test_odd_rows_match_brute_force(spark, block_rows):
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(0, 1, 5) + [2, 0, 0, 0, 0])], int(rng.integers(0, 3))) for i in range(0, 600, 5)]
    rows += [(10_000 + k, rows[0][1], k % 2) for k in range(40)]  # many ties
    rows += [(None, [1.0] * 5, 1), (7001, None, 1), (7002, [1.0, nan, 0.0, 0.0, 0.0], 1), (7003, [1.0, None, 0.0, 0.0, 0.0], 1), (7004, [inf] * 5, 2)]
    rows += [(7005, [1.0] * 5, None), (7006, [], 1), (7008, [3.0, 1.0], 2), (7009, [0.0] * 5, 0), (-300, [1.0] * 5, 0), rows[20], rows[20]]
    rows += [(200, [9.0] * 5, 2), (200, [8.0] * 5, 2)]  # one id, other vectors
    df = spark.createDataFrame([(*r, 1, "x", 1, 1, "x", 1, "x") for r in rows], SCHEMA)
    assert mined(df, block_rows=block_rows) == brute(rows)


def test_empty_table_and_table_without_anchors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mined(empty) == set() and hn.mine(empty, F.lit(True), F.col("label")).columns[0] == "anchor_id"
    assert mined(spark.createDataFrame([(1, [1.0], 1, 1, "x", 1, 1, "x", 1, "x")], SCHEMA)) == set()
