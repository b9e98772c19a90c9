"""Language identification of mixed-language texts.

Training sums hashed character n-grams (two and three characters, word borders included) per
language over labelled rows. A text is cut into words of one script; the script narrows the
candidates to languages that were seen with it. Each word scores every candidate by its
n-grams' log-probabilities, and a Viterbi pass with a fixed penalty for a change of language
turns the scores into spans. The text's language is the one with most letters in its spans.

Scoring is done on whole Arrow batches: n-grams, words and scores are flat numpy arrays, and
the Viterbi recursion runs over all texts of a batch at once, one word position a step.
"""

from __future__ import annotations

import sys
import unicodedata
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drivegrid.llm.common import null_empty

BUCKETS = 1 << 16
#: Labelled rows per language that the classifier is fitted on (about; chosen by hash of the id).
FIT_ROWS = 4000
SWITCH_PENALTY = 6.0
#: Share of the probability that is spread evenly over all n-grams.
UNSEEN = 0.05
#: Characters whose n-grams are scored at once (less with many languages), and characters of
#: the texts that take the Viterbi steps together: bounds of the arrays, not of the texts.
SCORE_CHARS, STEP_CHARS = 400_000, 4_000_000

#: First code points of script ranges and the script that begins there.
SCRIPT_STARTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"),
    (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"), (0x31F0, "kana"),
    (0x3200, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"),
    (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"), (0x30000, "other"),
]
SCRIPTS = sorted({s for _, s in SCRIPT_STARTS})
_TABLE: list[np.ndarray] = []


def _script_table() -> np.ndarray:
    """For each code point: 0 if no letter or mark, else 1 + number of its script. Built once a
    worker, with a table of the marks: these stand in words, but make none alone."""
    if not _TABLE:
        starts = [a for a, _ in SCRIPT_STARTS]
        out, marks = np.zeros(sys.maxunicode + 1, dtype=np.uint8), np.zeros(sys.maxunicode + 1, dtype=bool)
        for cp in range(0x323B0):  # letters end before this code point
            category = unicodedata.category(chr(cp))[0]
            if category in "LM":
                out[cp] = 1 + SCRIPTS.index(SCRIPT_STARTS[bisect_right(starts, cp) - 1][1])
                marks[cp] = category == "M"
        _TABLE.extend((out, marks))
    return _TABLE[0]


@dataclass
class Words:
    """All words of a batch: flat n-gram buckets, and per word its first n-gram, text, length, script."""

    doc: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    script: np.ndarray
    grams: np.ndarray | None = None
    first: np.ndarray | None = None


def words_of(texts: list[str]) -> Words:
    """Words are runs of letters of one script, lower-cased; border marks join their n-grams."""
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
    # a space between texts keeps their words apart
    code = np.frombuffer(" ".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    kind = _script_table()[code]
    step = np.flatnonzero(np.diff(kind, prepend=0) != 0)
    begin = step[kind[step] > 0]
    end = np.append(step, len(code))[np.searchsorted(step, begin, side="right")]
    letters = np.concatenate(([0], np.cumsum((kind > 0) & ~_TABLE[1][code])))
    some = letters[end] > letters[begin]
    begin, end = begin[some], end[some]
    length = end - begin
    if not len(begin):
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, none, none, none, none)
    # characters of all words with a border mark (0) on both sides
    first = np.concatenate(([0], np.cumsum(length + 2)))
    padded = np.zeros(first[-1], dtype=np.uint64)
    put = np.arange(first[-1]) - np.repeat(first[:-1], length + 2)
    inside = (put > 0) & (put <= np.repeat(length, length + 2))
    padded[inside] = _lower(code)[np.repeat(begin, length) + put[inside] - 1]
    two = padded[:-1] * np.uint64(0x9E3779B1) + padded[1:]
    three = two[:-1] * np.uint64(0x85EBCA77) + padded[2:] + np.uint64(0x27D4EB2F)
    # per word of n letters: n + 1 pairs and n triples, laid out together
    n2, n3 = length + 1, length
    at = np.concatenate(([0], np.cumsum(n2 + n3)))
    grams = np.empty(at[-1], dtype=np.uint64)
    k2 = np.arange(n2.sum()) - np.repeat(np.cumsum(n2) - n2, n2)
    k3 = np.arange(n3.sum()) - np.repeat(np.cumsum(n3) - n3, n3)
    grams[np.repeat(at[:-1], n2) + k2] = two[np.repeat(first[:-1], n2) + k2]
    grams[np.repeat(at[:-1] + n2, n3) + k3] = three[np.repeat(first[:-1], n3) + k3]
    grams *= np.uint64(0xC2B2AE3D27D4EB4F)
    doc = np.searchsorted(starts, begin, side="right") - 1
    return Words(doc, begin - starts[doc], length, kind[begin].astype(np.int64) - 1, (grams >> np.uint64(48)).astype(np.int64), at[:-1])


_LOWER: list[np.ndarray] = []


def _lower(code: np.ndarray) -> np.ndarray:
    """Simple lower case, one code point for one, so positions stay those of the text."""
    if not _LOWER:
        table = np.arange(sys.maxunicode + 1, dtype=np.uint32)
        for cp in range(0x1E944):
            low = chr(cp).lower()
            if len(low) == 1:
                table[cp] = ord(low)
        _LOWER.append(table)
    return _LOWER[0][code].astype(np.uint64)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (BUCKETS, languages) log-probabilities
    allowed: np.ndarray  # (scripts, languages)
    prior: np.ndarray


def _parts(texts: list[str], chars: int):
    """Texts in blocks of about so many characters, to bound the arrays."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield at, texts[at:k]
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield at, texts[at:]


def fit(df: DataFrame, row_id: str = "doc_id", text: str = "text", lang: str = "lang", fit_rows: int = FIT_ROWS) -> Model:
    """Model from labelled rows; of a language with more than ``fit_rows`` rows about that many
    are used, chosen by a hash of the id. What returns to the driver is bounded by buckets and
    languages. Rows with a null label or text are not used; without any the model knows none."""
    rows = df.select(F.col(row_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = dict(rows.groupBy("lang").count().collect())
    langs = sorted(counts)
    share = F.create_map(*[F.lit(v) for k in langs for v in (k, float(fit_rows) / counts[k])]) if langs else None
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool), np.zeros(0))
    chosen = rows.filter((F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003.0) < F.element_at(share, F.col("lang")))
    number = {v: k for k, v in enumerate(langs)}

    def run(batches):
        total = np.zeros((len(langs), BUCKETS), dtype=np.int64)
        scripts = np.zeros((len(langs), len(SCRIPTS)), dtype=np.int64)
        for pdf in batches:
            which = pdf["lang"].map(number).to_numpy()
            for at, texts in _parts(pdf["text"].tolist(), SCORE_CHARS):
                w = words_of(texts)
                if not len(w.first):
                    continue
                of_word = which[at + w.doc]
                per_word = np.diff(np.append(w.first, len(w.grams)))
                total += np.bincount(np.repeat(of_word, per_word) * BUCKETS + w.grams, minlength=total.size).reshape(total.shape)
                scripts += np.bincount(of_word * len(SCRIPTS) + w.script, weights=w.length, minlength=scripts.size).reshape(scripts.shape).astype(np.int64)
        for table, values in ((0, total), (1, scripts)):
            i, j = np.nonzero(values)
            yield pd.DataFrame({"kind": table, "lang": i, "k": j, "n": values[i, j]})

    found = chosen.select("text", "lang").mapInPandas(run, "kind int, lang int, k int, n long").groupBy("kind", "lang", "k").agg(F.sum("n").alias("n")).toPandas()
    grams, scripts = np.zeros((BUCKETS, len(langs))), np.zeros((len(SCRIPTS), len(langs)))
    g, s = found[found.kind == 0], found[found.kind == 1]
    grams[g.k, g.lang], scripts[s.k, s.lang] = g.n, s.n
    # an n-gram never seen is equally likely in all languages, however much text each has
    weights = np.log((1.0 - UNSEEN) * grams / np.maximum(grams.sum(0), 1) + UNSEEN / BUCKETS)
    allowed = scripts >= np.maximum(1, 0.01 * scripts.sum(0))
    prior = np.array([counts[v] for v in langs], dtype=float)
    return Model(langs, weights.astype(np.float32), allowed, prior / prior.sum())


def viterbi(scores: np.ndarray, doc: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word; ``scores`` are (words, labels), ``doc`` ascends."""
    n, labels = scores.shape
    heads = np.flatnonzero(np.diff(doc, prepend=-1) != 0)
    sizes = np.diff(np.append(heads, n))
    order = np.argsort(-sizes, kind="stable")  # longest text first: those still open are a prefix
    heads, sizes = heads[order], sizes[order]
    back = np.empty((n, labels), dtype=np.uint8 if labels < 256 else np.uint16)
    value = scores[heads].astype(np.float64)
    open_at = np.searchsorted(-sizes, -np.arange(sizes[0] + 1), side="left") if len(sizes) else np.zeros(1, int)
    same = np.arange(labels)
    for t in range(1, sizes[0] if len(sizes) else 0):
        k = open_at[t]
        v = value[:k]
        best = v.argmax(1)
        top = v[np.arange(k), best] - penalty
        stay = v >= top[:, None]
        at = heads[:k] + t
        back[at] = np.where(stay, same, best[:, None])
        value[:k] = np.where(stay, v, top[:, None]) + scores[at]
    out = np.empty(n, dtype=np.int64)
    state = value.argmax(1) if len(sizes) else np.zeros(0, int)
    for t in range(sizes[0] - 1 if len(sizes) else -1, -1, -1):
        k = open_at[t]
        at = heads[:k] + t
        out[at] = state[:k]
        if t:
            state[:k] = back[at, state[:k]]
    return out


def label_words(model: Model, texts: list[str], penalty: float = SWITCH_PENALTY) -> tuple[Words, np.ndarray]:
    """The words of some texts and the language number of each."""
    found, scored = [], []
    for at, part in _parts(texts, 4 * SCORE_CHARS // max(4, len(model.langs))):
        w = words_of(part)
        if not len(w.doc):
            continue
        scores = np.add.reduceat(model.weights[w.grams], w.first, axis=0)
        open_ = model.allowed[w.script]
        scores[~open_ & open_.any(1, keepdims=True)] = -1e6  # a script none was seen with leaves all open
        scores[~open_.any(1)] = 0.0
        found.append((w.doc + at, w.begin, w.length, w.script))
        scored.append(scores)
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, none, none), none
    words = Words(*(np.concatenate(c) for c in zip(*found)))
    return words, viterbi(np.concatenate(scored), words.doc, penalty)


def decide(m: Model, texts: list[str], penalty: float, spans: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Language name, its share of letters, that of all languages together and spans of each text."""
    names = np.array([*m.langs, "und"], dtype=object)
    pred, score, known_share, found = np.full(len(texts), len(m.langs)), np.zeros(len(texts)), np.zeros(len(texts)), [[] for _ in texts] if spans else []
    for first, part in _parts(texts, STEP_CHARS) if m.langs else ():
        w, label = label_words(m, part, penalty)
        if not len(label):
            continue
        known = m.allowed[w.script].any(1)
        cell = w.doc * len(m.langs) + label
        letters = np.bincount(cell, weights=w.length * known, minlength=len(part) * len(m.langs)).reshape(len(part), -1)
        total = np.bincount(w.doc, weights=w.length, minlength=len(part))
        best = np.where(letters.any(1), letters.argmax(1), m.prior.argmax())
        here = total > 0
        pred[first:first + len(part)] = np.where(here, best, len(m.langs))
        score[first:first + len(part)] = np.where(here, letters.max(1) / np.maximum(total, 1), 0.0)
        known_share[first:first + len(part)] = np.where(here, letters.sum(1) / np.maximum(total, 1), 0.0)
        if spans:
            turn = np.flatnonzero((np.diff(w.doc, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0))
            after = np.append(turn[1:], len(label)) - 1
            for a, b in zip(turn, after):
                found[first + w.doc[a]].append((int(w.begin[a]), int(w.begin[b] + w.length[b]), names[label[a]]))
    return names[pred], score, known_share, found


def filter_texts(df: DataFrame, model: Model, min_share: float, text: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """The rows of ``df`` whose text has at least ``min_share`` of its letters in words that a known
    language was given, all languages together: texts that mix several stay. Null texts, texts without a letter and unknown scripts go. All columns stay as they are."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text)

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                texts = ["" if t is None else t for t in batch.column(at).to_pylist()]
                names, _, known, _ = decide(shared.value, texts, penalty)
                yield batch.filter(pa.array((names != "und") & (known >= min_share)))

    return df.mapInArrow(run, df.schema)


def predict(df: DataFrame, model: Model, row_id: str = "doc_id", text: str = "text", penalty: float = SWITCH_PENALTY, spans: bool = False) -> DataFrame:
    """``doc_id, lang_pred, score`` (and ``spans``): one row per input row.

    ``score`` is the share of letters in the predicted language. A null text, or one without a
    letter, is ``und`` with score 0, as is everything when the model knows no language. A text
    whose scripts were never seen goes to the most frequent language with score 0. Ties go to
    the language first in order. Spans are (first character, after, language).
    """
    schema = "doc_id long, lang_pred string, score double" + (", spans array<struct<first:long,after:long,lang:string>>" if spans else "")
    shared = df.sparkSession.sparkContext.broadcast(model)  # buckets * languages

    def run(batches):
        for pdf in batches:
            names, score, _, found = decide(shared.value, pdf["text"].tolist(), penalty, spans)
            out = pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "lang_pred": names, "score": score})
            yield out.assign(spans=found) if spans else out

    rows = df.select(F.col(row_id).cast("long").alias("doc_id"), null_empty(text).alias("text"))
    return rows.mapInPandas(run, schema)


def held_out(row_id: str, of: int = 4, remainder: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(row_id).cast("string").cast("binary")), F.lit(of)) == remainder, F.lit(False))
