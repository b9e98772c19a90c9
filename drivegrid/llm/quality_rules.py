"""Quality rules: counted faults of a text and a calibrated classifier of hashed n-grams.

Two fixed rules count words, repeated three-word windows, repeated lines and symbols. What they
pass is judged by a logistic regression over hashed word (one, two) and character (one to four)
n-grams. A feature's value is its share among the n-grams of its order, so a text's logit is a
sum of means and is read off flat arrays, many texts at a time.

The regression is fitted to labelled rows, about ``FIT_ROWS`` of them (chosen by a hash of the
id, one text an id). Their features are written once as compact blocks; every step of the
descent is one pass over the blocks, whose partial gradients are summed on the driver (one
short array a task; blocks are few because the fit is bounded). A fifth of the rows is held out
to calibrate the logit (a slope and an intercept), so the score is a probability and the
threshold keeps its meaning when the model changes. Scoring needs no shuffle.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drivegrid.llm.common import null_empty, written

#: Bits of the feature hash.
BITS = 17
#: Labelled rows that the classifier is fitted to (about).
FIT_ROWS = 4000
#: Passes of the descent, its ridge, and the blocks that the fitted rows are dealt into.
STEPS, RIDGE, FIT_TASKS = 12, 1e-6, 6
#: Rules: fewest words; most words, in per cent, inside repeated three-word windows.
MIN_WORDS, MOST_REPEATED = 50, 50
#: Texts with a smaller probability of being good are rejected.
MIN_PROBABILITY = 0.5
#: Characters whose n-grams are held at once (at least one text).
SLICE_CHARS = 2_000_000

#: White space that parts words, and the symbols that are counted.
WHITE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"

_ORDERS = (1, 2, 3, 4)
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * logit + self.shift, -500, 500)))


class Slice:
    """Counts and n-grams of a few texts in flat arrays."""

    def __init__(self, texts: list[str]):
        self.n = len(texts)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.ends = np.cumsum(sizes + 1)
        self.starts = self.ends - sizes - 1
        # one blank after each text: n-grams that touch it from outside are left out
        self.points = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.sizes = sizes
        split = [t.encode("utf-8", "surrogatepass").split() for t in texts]  # bytes split at the ASCII white space
        self.n_words = np.array([len(w) for w in split], dtype=np.int64)
        self.words, self.kinds = pd.factorize(np.array([w for words in split for w in words], dtype=object))
        self.words = self.words.astype(np.int64)
        self.doc = np.repeat(np.arange(self.n), self.n_words)

    def counts(self, texts: list[str]) -> pd.DataFrame:
        p = self.points
        white = (p == 32) | ((p >= 9) & (p <= 13))
        symbol = np.isin(p, np.array([ord(c) for c in SYMBOLS], dtype=np.uint32))
        per = [np.concatenate(([0], np.cumsum(x)))[np.concatenate(([0], self.ends))] for x in (~white, symbol)]
        dup = np.zeros(self.n, dtype=np.int64)
        for k, t in enumerate(texts):
            if "\n" in t:
                lines = [x for x in t.split("\n") if x.strip(WHITE)]
                dup[k] = len(lines) - len(set(lines))
        return pd.DataFrame({
            "n_words": self.n_words, "word_chars": np.diff(per[0]), "n_symbols": np.diff(per[1]), "n_dup_lines": dup, "n_repeat_words": self._repeated(),
        })

    def _repeated(self) -> np.ndarray:
        """Words inside three-word windows that come twice or more in their text; exact, as
        windows are compared by the numbers of their words."""
        w, d = self.words, self.doc
        if len(w) < 3:
            return np.zeros(self.n, dtype=np.int64)
        pair = pd.factorize((w[:-1] << 31) | w[1:])[0].astype(np.int64)
        triple = pd.factorize((pair[:-1] << 31) | w[2:])[0].astype(np.int64)
        inside = np.flatnonzero(d[:-2] == d[2:])
        window = pd.factorize((triple[inside] << 31) | d[inside])[0]
        again = inside[np.bincount(window)[window] > 1] if len(inside) else inside
        hit = np.zeros(len(w), dtype=bool)
        for k in range(3):
            hit[again + k] = True
        return np.bincount(d, weights=hit, minlength=self.n).astype(np.int64)

    def features(self):
        """For each order of n-grams: buckets of all occurrences and the text of each."""
        p, at = self.points.astype(np.uint64), np.repeat(np.arange(self.n), self.sizes + 1)
        left = np.repeat(self.ends - 1, self.sizes + 1) - np.arange(len(p))  # characters from here to the text's end
        h = np.zeros(len(p), dtype=np.uint64)
        for n in _ORDERS:
            if n > len(p):
                break
            h = h[:len(p) - n + 1] * np.uint64(0x100000001B3) + p[n - 1:] + np.uint64(n)
            fits = left[:len(h)] >= n
            yield _bucket(h[fits], n), at[:len(h)][fits]
        hashes = np.fromiter((zlib.crc32(w) for w in self.kinds), dtype=np.uint64, count=len(self.kinds))
        word = hashes[self.words] if len(self.words) else np.zeros(0, dtype=np.uint64)
        yield _bucket(word, 11), self.doc
        both = self.doc[:-1] == self.doc[1:]
        yield _bucket((word[:-1] * np.uint64(0x100000001B3) ^ word[1:])[both], 12), self.doc[:-1][both]

    def logits(self, model: Model) -> np.ndarray:
        out = np.full(self.n, model.bias)
        for buckets, doc in self.features():
            n = np.bincount(doc, minlength=self.n)
            out += np.bincount(doc, weights=model.weights[buckets], minlength=self.n) / np.maximum(n, 1)
        return out


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind)) * _MIX
    h ^= h >> np.uint64(29)
    return ((h * _MIX) >> np.uint64(64 - BITS)).astype(np.int64)


def _slices(texts: list[str]):
    """Runs of texts of at most ``SLICE_CHARS`` characters; a longer text stands alone."""
    first, chars = 0, 0
    for k, t in enumerate(texts):
        if k > first and chars + len(t) > SLICE_CHARS:
            yield first, k
            first, chars = k, 0
        chars += len(t)
    if texts:
        yield first, len(texts)


def _sample(docs: DataFrame, labels: DataFrame, row_id: str, text: str, fit_rows: int) -> DataFrame:
    """About ``fit_rows`` rows ``doc_id, text, good``: one an id, chosen by a hash of the id.
    Their ids are broadcast: 9 bytes each, at most about ``fit_rows``."""
    per = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = written(per.agg((F.avg("quality") >= 0.5).alias("good")))
    share = fit_rows / max(known.count(), 1)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(share, 1.0) * (1 << 30))
    rows = docs.select(F.col(row_id).cast("long").alias("doc_id"), null_empty(text).alias("text"))
    return rows.join(F.broadcast(known.filter(part)), "doc_id").groupBy("doc_id", "good").agg(F.max("text").alias("text"))


def _blocks(sample: DataFrame) -> DataFrame:
    """Rows ``held, good, doc, bucket, value``: arrays of some texts each, as bytes."""

    def run(batches):
        for pdf in batches:
            for a, b in _slices(list(pdf["text"])):
                part = pdf.iloc[a:b]
                s = Slice(list(part["text"]))
                keys, values = [], []
                for bucket, doc in s.features():
                    n = np.bincount(doc, minlength=s.n)
                    key, count = np.unique((doc << BITS) | bucket, return_counts=True)
                    keys.append(key)
                    values.append(count / n[key >> BITS])
                key, value = np.concatenate(keys), np.concatenate(values)
                held = np.array([zlib.crc32(str(d).encode()) % 5 == 0 for d in part["doc_id"]])
                yield pd.DataFrame([{
                    "held": held.tobytes(), "good": part["good"].to_numpy(dtype=bool).tobytes(), "doc": (key >> BITS).astype(np.int32).tobytes(),
                    "bucket": (key & ((1 << BITS) - 1)).astype(np.int32).tobytes(), "value": value.astype(np.float32).tobytes(),
                }])

    return sample.repartition(FIT_TASKS).mapInPandas(run, "held binary, good binary, doc binary, bucket binary, value binary")


def _arrays(row):
    return (
        np.frombuffer(row.held, dtype=bool), np.frombuffer(row.good, dtype=bool), np.frombuffer(row.doc, dtype=np.int32),
        np.frombuffer(row.bucket, dtype=np.int32), np.frombuffer(row.value, dtype=np.float32),
    )


def _pass(blocks: DataFrame, weights: np.ndarray, bias: float, balance: tuple[float, float]) -> tuple[np.ndarray, float, np.ndarray]:
    """Gradient, its bias and the diagonal of the curvature bound over the rows not held out."""

    def run(batches):
        g, gb, curve = None, 0.0, None
        for pdf in batches:
            if g is None:
                g, curve = np.zeros(1 << BITS), np.zeros(1 << BITS)
            for row in pdf.itertuples(index=False):
                held, good, doc, bucket, value = _arrays(row)
                z = bias + np.bincount(doc, weights=weights[bucket] * value, minlength=len(good))
                importance = np.where(good, balance[1], balance[0]) * ~held
                residual = importance * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - good)
                g += np.bincount(bucket, weights=value * residual[doc], minlength=1 << BITS)
                curve += np.bincount(bucket, weights=value * importance[doc], minlength=1 << BITS)
                gb += residual.sum()
        if g is not None:
            yield pd.DataFrame([{"g": g.astype(np.float32).tobytes(), "b": gb, "curve": curve.astype(np.float32).tobytes()}])

    parts = blocks.mapInPandas(run, "g binary, b double, curve binary").collect()
    total = [sum((np.frombuffer(bytes(p[c]), dtype=np.float32).astype(float) for p in parts), np.zeros(1 << BITS)) for c in ("g", "curve")]
    return total[0], sum(p["b"] for p in parts), total[1]


def fit(docs: DataFrame, labels: DataFrame, row_id: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS, steps: int = STEPS) -> Model:
    """A classifier of good texts from ``labels`` (``doc_id, quality``).

    Labels with a null id or quality are left out; an id with several labels counts as good
    when their mean is at least 0.5, an id with several texts as the greatest one. Without
    labels of both kinds every text that passes the rules gets the share of good labels (1 if
    there are none)."""
    blocks = written(_blocks(_sample(docs, labels, row_id, text, fit_rows)))
    flags = [(np.frombuffer(bytes(r.held), dtype=bool), np.frombuffer(bytes(r.good), dtype=bool)) for r in blocks.select("held", "good").collect()]
    held, good = (np.concatenate([f[k] for f in flags] or [np.zeros(0, dtype=bool)]) for k in (0, 1))
    weights, bias = np.zeros(1 << BITS), 0.0
    n_good, n_bad = int((good & ~held).sum()), int((~good & ~held).sum())
    if not n_good or not n_bad:
        share = good.mean() if len(good) else 1.0
        return Model(weights, 50.0 if share == 1 else -50.0 if share == 0 else float(np.log(share / (1 - share))))
    balance = (0.5 / n_bad, 0.5 / n_good)
    # momentum on a diagonal bound of the curvature: a row's values sum to its number of orders
    ahead, old, bias_ahead, bias_old, scale = weights, weights, 0.0, 0.0, None
    for k in range(steps):
        g, gb, curve = _pass(blocks, ahead, bias_ahead, balance)
        if scale is None:
            scale = np.where(curve > 0, 1.0 / (0.25 * (len(_ORDERS) + 3) * curve + RIDGE), 0.0)
        new, bias_new = ahead - scale * (g + RIDGE * ahead), bias_ahead - gb / (0.25 * (len(_ORDERS) + 3))
        step = k / (k + 3)
        ahead, bias_ahead = new + step * (new - old), bias_new + step * (bias_new - bias_old)
        old, bias_old = new, bias_new
    model = Model(old.astype(np.float32), bias_old)
    return _calibrated(model, blocks)


def _calibrated(model: Model, blocks: DataFrame) -> Model:
    """Slope and intercept of the logit from the held-out rows, by Newton steps."""

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                held, good, doc, bucket, value = _arrays(row)
                z = model.bias + np.bincount(doc, weights=model.weights[bucket] * value, minlength=len(good))
                yield pd.DataFrame({"z": z[held], "good": good[held].astype(float)})

    rows = blocks.mapInPandas(run, "z double, good double").toPandas()  # at most about a fifth of the fitted rows
    z, y = rows["z"].to_numpy(), rows["good"].to_numpy()
    if y.min(initial=1) == y.max(initial=0):
        return model
    # targets a little inside 0 and 1 keep the slope finite when the kinds part completely
    y = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a = np.zeros(2)
    x = np.stack([z, np.ones_like(z)], axis=1)
    spread = max(float(np.abs(z).max()), 1e-9)
    x[:, 0] /= spread
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -500, 500)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-9 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - y))
        a -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
    if a[0] <= 0:  # the held-out rows contradict the fit: the score says nothing
        return model
    return Model(model.weights, model.bias, float(a[0] / spread), float(a[1]))


_OUT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, probability double"
)


def judge(
    df: DataFrame, model: Model, row_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, most_repeated: int = MOST_REPEATED, min_probability: float = MIN_PROBABILITY,
) -> DataFrame:
    """One row per document with its counts, the rules' and the model's verdict.

    A null text has no words and fails. Rows are independent: repeated rows and null ids come
    back as they are; further columns are ignored; an empty table gives no rows."""

    def run(batches):
        for pdf in batches:
            texts = list(pdf["text"])
            for a, b in _slices(texts):
                s = Slice(texts[a:b])
                out = s.counts(texts[a:b])
                out.insert(0, "doc_id", pdf["doc_id"].iloc[a:b].astype("Int64").to_numpy())
                out["base_failed"] = (out["n_words"] < min_words) | (100 * out["n_repeat_words"] > most_repeated * out["n_words"])
                out["probability"] = model.probability(s.logits(model))
                out["kept"] = ~out["base_failed"] & (out["probability"] >= min_probability)
                yield out

    return df.select(F.col(row_id).cast("long").alias("doc_id"), null_empty(text).alias("text")).mapInPandas(run, _OUT)

