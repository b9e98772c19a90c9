"""Near-duplicate texts and vectors against all pairs."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest

from drivegrid.llm import jaccard_join, vector_links

SF = "/root/testdata/sf0.001/documents.parquet"


def rows(df):
    return [r.asDict() for r in df.collect()]


def components(nodes, links):
    top = {n: n for n in nodes}
    while True:
        changed = False
        for a, b in links:
            low = min(top[a], top[b])
            changed |= top[a] != low or top[b] != low
            top[a] = top[b] = low
        if not changed:
            return top


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_texts(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    links, n = [], [0] * len(sets)
    for (i, (a, x)), (j, (b, y)) in itertools.combinations(enumerate(sets), 2):
        if a is not None and b is not None and x and y and len(x & y) >= 0.8 * len(x | y) - 1e-12:
            links.append((a, b))
            n[i] += 1
            n[j] += 1
    top = components({d for d, _ in sets if d is not None}, links)
    return Counter((d, n[k], top.get(d), d is None or top[d] == d) for k, (d, _) in enumerate(sets))


def near_text(k, words=60):
    rng = np.random.default_rng(k // 12)
    base = [f"w{v}" for v in rng.integers(0, 5000, words)]
    for at in np.random.default_rng(1000 + k).choice(words, k % 4, replace=False):
        base[at] = f"new{k}"
    return " ".join(base)


@pytest.mark.parametrize("which", ["odd", "table", "near"])
def test_near_copies_match_all_pairs(spark, odd, which):
    if which == "near":
        df = spark.createDataFrame([(k, near_text(k)) for k in range(120)], "doc_id long, text string")
    else:
        df = odd.filter("doc_id IS NULL OR doc_id <> 8") if which == "odd" else spark.read.parquet(SF)
    # small blocks, so that groups meet as pairs of blocks
    got = rows(jaccard_join.near_copies(df, block_shingles=3000))
    want = brute_texts([(r["doc_id"], r["text"]) for r in rows(df.select("doc_id", "text"))])
    assert Counter((r["doc_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == want


def test_near_copies_keep_one_of_each_component(spark, empty):
    df = spark.createDataFrame([(k, near_text(k), "x") for k in range(48)], "doc_id long, text string, node string")
    kept = jaccard_join.keep_one(df)
    tops = {r["component_id"] for r in rows(jaccard_join.near_copies(df))}
    assert kept.columns == df.columns and {r["doc_id"] for r in rows(kept)} == tops
    assert jaccard_join.near_copies(empty).collect() == [] and jaccard_join.keep_one(empty).count() == 0


def test_repeated_ids_are_one_node(odd):
    got = [r for r in rows(jaccard_join.near_copies(odd)) if r["doc_id"] == 8]
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in got] == [(1, 8, True)] * 2


def test_minhash_and_prefix_chance():
    one = jaccard_join.shingles_of([b"a%d" % k for k in range(400)])
    two = jaccard_join.shingles_of([b"a%d" % k for k in range(40, 400)])
    s = len(np.intersect1d(one, two)) / len(np.union1d(one, two))
    assert np.mean(jaccard_join.minhash(one, 2000) == jaccard_join.minhash(two, 2000)) == pytest.approx(s, abs=0.03)
    d = jaccard_join.floor_depth(0.8, 20, 6, 0.9995)
    assert jaccard_join.chance(0.8, d, 20) >= 0.9995 and jaccard_join.chance(0.8, d + 1, 20) < 0.9995


def test_intersections_both_ways():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 120))).astype(np.uint64) for _ in range(12)]
    a, b = np.array(list(itertools.combinations(range(12), 2))).T
    want = [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b)]
    assert jaccard_join.intersections(sets, a, b).tolist() == want
    assert jaccard_join.intersections(sets, a[:3], b[:3]).tolist() == want[:3]


def usable(v):
    return v and all(c is not None and math.isfinite(c) for c in v) and any(v)


def brute_vectors(table):
    links, n = [], [0] * len(table)
    for (i, (a, x, p)), (j, (b, y, q)) in itertools.combinations(enumerate(table), 2):
        if a is None or b is None or p is None or p != q or not usable(x) or not usable(y) or len(x) != len(y):
            continue
        x, y = np.array(x, dtype=float), np.array(y, dtype=float)
        if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
            links.append((a, b))
            n[i] += 1
            n[j] += 1
    top = components({a for a, _, _ in table if a is not None}, links)
    return Counter((a, n[k], top.get(a), a is None or top[a] == a) for k, (a, _, _) in enumerate(table))


def vector_table():
    rng = np.random.default_rng(9)
    table = []
    for k in range(300):
        base = np.random.default_rng(k // 6).normal(size=8)
        v = (base + 0.15 * rng.normal(size=8)).astype(np.float32)
        table.append((k, [float(c) for c in v], k % 2))
    table += [(300, table[0][1], 0), (301, table[0][1], None), (302, None, 0), (303, [0.0] * 8, 0), (304, [float("nan")] * 8, 0), (305, [], 0)]
    table += [(306, [None, *table[0][1][1:]], 0), (307, table[0][1][:4], 0), (308, table[0][1][:4], 0), (None, table[0][1], 0), (309, [float("inf")] * 8, 0)]
    return table


@pytest.mark.parametrize("block_rows", [7, 1024])
def test_vector_links_match_all_pairs(spark, block_rows):
    table = vector_table()
    df = spark.createDataFrame([(*r, "x", 1) for r in table], "vec_id long, embedding array<float>, label int, node string, pivot int")
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rows(vector_links.link_vectors(df, block_rows=block_rows)))
    want = brute_vectors(table)
    found, all_links = sum(k[1] * c for k, c in got.items()), sum(k[1] * c for k, c in want.items())
    assert sum(got.values()) == len(table) and 0.98 * all_links <= found <= all_links
    if found == all_links:
        assert got == want


def test_no_vectors(spark):
    assert vector_links.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
    one = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in vector_links.link_vectors(one).collect()] == [(1, 1, 1, True)] * 2


def test_recall_inside_a_dense_cluster(spark):
    import pandas as pd

    rng = np.random.default_rng(4)
    n, dense = 30_000, 10_000
    x = rng.normal(size=(n, 64))
    x[:dense] = x[0] / np.linalg.norm(x[0]) + rng.normal(size=(dense, 64)) * (0.11 ** 0.5 / 8)  # mutual cosine about 0.9
    x = x.astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": list(x), "label": 0}), "vec_id long, embedding array<float>, label int")
    got = np.zeros(n, dtype=np.int64)
    for r in vector_links.link_vectors(df.repartition(8)).select("vec_id", "n_links").collect():
        got[r[0]] = r[1]
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = np.concatenate([(unit[k:k + 1000] @ unit.T >= 0.93).sum(1) - 1 for k in range(0, n, 1000)])
    assert want[:dense].sum() > 100_000 and (got <= want).all()
    assert got.sum() >= 0.98 * want.sum()
