"""Near-duplicate documents by word-shingle Jaccard similarity: a MinHash LSH forest join.

Every text has ``TREES`` sequences of ``DEPTH`` MinHash values. In tree t a text is the path of
its t-th sequence, so texts that share a prefix of it are neighbours in the sorted trie. Two
neighbourhoods are compared with the longest prefixes first, which are then shortened step by
step; at each step the pairs that newly share a prefix in some tree are verified by the exact
Jaccard similarity of their shingle sets. From the similarities found follows how many links
the prefixes have missed (each pair found weighs 1 / its chance of being found); shortening
ends when the target recall is reached, or at ``floor_depth``, where the chance at the
threshold itself exceeds the target.

Nothing is emitted pair by pair. Texts with equal words are one class from the start. Classes
that share a prefix with another are candidates; they are sorted by their smallest neighbour
and path and cut into blocks of bounded total size. The texts of two blocks that share a
prefix meet in one task, which verifies the candidate pairs with array operations and returns
link counts and a spanning forest. A group of near copies of any size is thus many block pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drivegrid.llm.common import components, free_names, null_empty, running_totals, written

WORDS = 5
THRESHOLD = 0.8
TREES = 20
DEPTH = 6
TARGET_RECALL = 0.9995
BLOCK_SHINGLES = 200_000
_CACHE_WORDS = 400_000
_MASK = (1 << 64) - 1


class _WordHash(dict):
    """64-bit hashes of words, in a bounded cache."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHash()


def words_of(text: str) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8").lower().split()


def shingles_of(words: list[bytes], size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of ``size`` words; a shorter text is one run."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, len(words) if len(words) < WORDS else 0, dtype=np.uint64)
    for k in range(size):
        out = (out ^ h[k:len(h) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def digest_of(words: list[bytes]) -> bytes | None:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1097)
    return rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def minhash(shingles: np.ndarray, n: int, _made: dict = {}) -> np.ndarray:  # noqa: B006  (a cache)
    """``n`` MinHash values of a set of 64-bit shingles."""
    if n not in _made:
        _made[n] = _multipliers(n)
    a, b = _made[n]
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(n, 2**32 - 1, dtype=np.uint32)
    for at in range(0, len(x), 1024):
        part = a[:, None] * x[None, at:at + 1024]
        part += b[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return low


def paths(signature: np.ndarray, depth: int) -> np.ndarray:
    """64-bit name of the depth-long prefix in each tree."""
    sig = signature.reshape(-1, signature.shape[-1])[:, :].astype(np.uint64)
    out = np.full(sig.shape[0], 0x51ED270B, dtype=np.uint64)
    for k in range(depth):
        out = (out ^ sig[:, k]) * np.uint64(0xC2B2AE3D27D4EB4F)
        out ^= out >> np.uint64(29)
    return out


def chance(s: float | np.ndarray, depth: int, trees: int):
    """Probability that a pair of similarity s shares a prefix of this depth in some tree."""
    return 1.0 - (1.0 - s**depth) ** trees


def floor_depth(threshold: float, trees: int, depth: int, target: float) -> int:
    """The longest prefix whose chance at the threshold reaches the target (1 at least)."""
    return next((d for d in range(depth, 1, -1) if chance(threshold, d, trees) >= target), 1)


def _signatures(df: DataFrame, row_id: str, text: str, size: int, trees: int, depth: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            digests, signs, counts = [], [], []
            for t in pdf["text"]:
                words = words_of(t)
                shingles = shingles_of(words, size)
                counts.append(len(shingles))
                digests.append(digest_of(words))
                signs.append(minhash(shingles, trees * depth).tobytes() if words else None)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "digest": digests, "n": counts, "sig": signs})

    rows = df.select(F.col(row_id).cast("long").alias("doc_id"), null_empty(text).alias("text"))
    return rows.mapInPandas(run, "doc_id long, digest binary, n long, sig binary")


def _keys(classes: DataFrame, trees: int, depth: int, use: int) -> DataFrame:
    """``node, tree_key``: the prefixes of a class, one row a tree."""

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            sig = np.stack([np.frombuffer(b, dtype=np.uint32).reshape(trees, depth) for b in pdf["sig"]])
            sig = np.concatenate([np.broadcast_to(np.arange(trees, dtype=np.uint32)[None, :, None], (len(pdf), trees, 1)), sig], axis=2)
            key = paths(sig.reshape(-1, depth + 1), use + 1)
            yield pd.DataFrame({"node": np.repeat(pdf["node"].to_numpy(), trees), "tree_key": key.astype(np.int64)})

    return classes.select("node", "sig").mapInPandas(run, "node long, tree_key long")


def _verify_blocks(threshold: float, trees: int, depth: int, floor: int, target: float):
    """Checks the candidate pairs of two blocks (or of one with itself)."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = int(key[0]), int(key[1])
        pdf = pdf.drop_duplicates(["node", "digest"]).sort_values("node")  # rows may repeat
        block = pdf["block"].to_numpy()
        left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
        sig = np.stack([np.frombuffer(b, dtype=np.uint32).reshape(trees, depth) for b in pdf["sig"]])
        sets = [np.frombuffer(b, dtype=np.uint64) for b in pdf["shingles"]]
        sizes = np.array([len(s) for s in sets], dtype=np.float64)
        near = np.triu(np.ones((len(left), len(right)), dtype=bool), 1) if one == two else np.ones((len(left), len(right)), dtype=bool)
        firsts, seconds = [], []
        found = expected = 0.0
        for use in range(depth, floor - 1, -1):
            fresh = _share(sig, left, right, use) & near
            near &= ~fresh
            i, j = np.nonzero(fresh)
            a, b = left[i], right[j]
            # the sizes bound the similarity
            can = np.minimum(sizes[a], sizes[b]) >= threshold * np.maximum(sizes[a], sizes[b])
            a, b = a[can], b[can]
            inter = intersections(sets, a, b)
            union = sizes[a] + sizes[b] - inter
            linked = inter >= threshold * union - 1e-9
            firsts.append(a[linked])
            seconds.append(b[linked])
            found += linked.sum()
            expected += (1.0 / chance((inter / np.maximum(union, 1))[linked], use, trees)).sum()
            if found and found >= target * expected:
                break
        a, b = np.concatenate(firsts), np.concatenate(seconds)
        node, mult = pdf["node"].to_numpy(), pdf["mult"].to_numpy()
        links = np.zeros(len(pdf), dtype=np.int64)
        np.add.at(links, a, mult[b])
        np.add.at(links, b, mult[a])
        hit = np.flatnonzero(links > 0)
        return pd.DataFrame({"node": node[hit], "top": node[spanning(len(pdf), a, b)[hit]], "links": links[hit]})

    return run


def _share(sig: np.ndarray, left: np.ndarray, right: np.ndarray, use: int) -> np.ndarray:
    """Which (left, right) pairs share a prefix of length ``use`` in some tree."""
    out = np.zeros((len(left), len(right)), dtype=bool)
    for t in range(sig.shape[1]):
        _, name = np.unique(sig[:, t, :use], axis=0, return_inverse=True)
        name = name.reshape(-1)
        out |= name[left][:, None] == name[right][None, :]
    return out


def intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (a[k], b[k]) of sorted sets.

    Few pairs a set are merged one by one; many are read from a product of 0/1 matrices over
    slices of the common vocabulary."""
    if not len(a):
        return np.zeros(0)
    involved = np.unique(np.concatenate([a, b]))
    if len(a) <= 4 * len(involved):
        return np.array([_common(sets[x], sets[y]) for x, y in zip(a, b)], dtype=np.float64)
    row = np.full(len(sets), -1)
    row[involved] = np.arange(len(involved))
    flat = np.concatenate([sets[k] for k in involved])
    owner = np.repeat(np.arange(len(involved)), [len(sets[k]) for k in involved])
    _, word, n = np.unique(flat, return_inverse=True, return_counts=True)
    shared = n[word] > 1
    word, owner = word[shared], owner[shared]
    _, word = np.unique(word, return_inverse=True)
    total = np.zeros((len(involved), len(involved)), dtype=np.float64)
    order = np.argsort(word, kind="stable")
    word, owner = word[order], owner[order]
    for at in range(0, int(word[-1]) + 1 if len(word) else 0, 8192):
        lo, hi = np.searchsorted(word, [at, at + 8192])
        part = np.zeros((len(involved), 8192), dtype=np.float32)
        part[owner[lo:hi], word[lo:hi] - at] = 1.0
        total += part @ part.T
    return total[row[a], row[b]]


def _common(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable by the links (a[k], b[k]), for each of n items."""
    top = np.arange(n)
    while len(a):
        low = np.minimum(top[a], top[b])
        new = top.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, top[a], low)
        np.minimum.at(new, top[b], low)
        new = new[new]
        if (new == top).all():
            break
        top = new
    return top


def _shingle_sets(df: DataFrame, chosen: DataFrame, row_id: str, text: str, size: int) -> DataFrame:
    """``chosen`` with the shingle set of each node's text."""

    def run(batches):
        for pdf in batches:
            words = [words_of(t) for t in pdf["text"]]
            same = np.array([digest_of(w) == bytes(d) for w, d in zip(words, pdf["digest"])], dtype=bool)  # an id may repeat
            yield pdf.assign(shingles=[shingles_of(w, size).tobytes() for w in words]).drop(columns="text")[same]

    texts = df.select(F.col(row_id).cast("long").alias("doc_id"), null_empty(text).alias("text"))
    joined = chosen.join(texts, F.col("node") == F.col("doc_id")).drop("doc_id")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema)
    return joined.mapInPandas(run, f"{kinds}, shingles binary")


def near_copies(
    df: DataFrame, row_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, size: int = WORDS,
    trees: int = TREES, depth: int = DEPTH, target: float = TARGET_RECALL, block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """``doc_id, class_id, n_links, component_id, kept``: one row per input row.

    ``class_id`` is the smallest id with the same words; ``n_links`` counts the other rows
    linked directly, rows of the same class included; ``component_id`` is the smallest id
    reachable by links and ``kept`` marks it. Empty and null texts link with nothing, nor do
    rows with a null id (they are kept, with null class and component). Rows that repeat an id
    are one node with the links of all their texts. An empty table gives no rows.
    """
    signed = written(_signatures(df, row_id, text, size, trees, depth))
    named = signed.filter("doc_id IS NOT NULL AND digest IS NOT NULL")
    classes = written(named.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("mult"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    links = _links(df, classes, row_id, text, threshold, size, trees, depth, floor_depth(threshold, trees, depth, target), target, block_shingles)
    return _assemble(signed, classes, links)


def _links(df, classes, row_id, text, threshold, size, trees, depth, floor, target, block_shingles) -> DataFrame:
    """``node, top, links``: link counts and spanning forests of all pairs of blocks."""
    keys = _keys(classes, trees, depth, floor)
    crowded = keys.groupBy("tree_key").agg(F.count("*").alias("c"), F.min("node").alias("low")).filter("c > 1")
    keys = written(keys.join(crowded, "tree_key").select("node", "tree_key", "low"))
    # texts stand beside the smallest one they share a prefix with: this only brings candidates
    # together in few blocks; texts with a common prefix meet wherever they stand
    near = keys.groupBy("node").agg(F.min("low").alias("beside"))
    cand = near.join(classes.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n")).select("beside", "node", "digest", "mult", "n", "sig")
    cand = cand.withColumns({"path": F.substring("sig", 1, 4 * depth), "n": F.col("n") + 500})
    cand = running_totals(cand, ["beside", "path", "node", "digest"], {"upto": F.col("n")})
    cand = written(cand.withColumn("block", F.expr(f"(upto - 1) div {block_shingles}L")).select("node", "digest", "mult", "sig", "block"))
    # a text goes to the meeting of its block with every block that holds one of its prefixes
    keyed = written(keys.join(cand.select("node", "block"), "node").select("node", "tree_key", "block"))
    other = keyed.select("tree_key", F.col("block").alias("other")).distinct()
    homes = keyed.join(other, "tree_key").select("node", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two")).distinct()
    # one text of each class gives its shingles
    sets = _shingle_sets(df, cand, row_id, text, size).select("node", "digest", "mult", "sig", "shingles", "block")
    pairs = sets.join(homes, "node")
    return written(pairs.groupBy("one", "two").applyInPandas(_verify_blocks(threshold, trees, depth, floor, target), "node long, top long, links long"))


def _assemble(signed: DataFrame, classes: DataFrame, every: DataFrame) -> DataFrame:
    own = classes.select("digest", F.col("node").alias("class_id"), "mult")
    rows = signed.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(own, "digest", "left")
    links = every.groupBy("node").agg(F.sum("links").alias("links"))
    known = written(links.join(components(every, "node", "top"), "node", "left"))
    out = rows.join(known.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"),
        (F.coalesce(F.col("mult") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("component", "class_id", "doc_id").alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(df: DataFrame, row_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that stay: one document of each component, with all columns."""
    (name,) = free_names(df, "_gone")
    gone = near_copies(df, row_id, text, **options).filter(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return df.join(gone, F.col(row_id) == F.col(name), "left_anti")
