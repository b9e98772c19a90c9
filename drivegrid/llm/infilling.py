"""Fill-in-the-middle transformation by repeated-capture matching.

A text is matched once, as a whole, against ``(unit)*``. The regex library keeps every
repetition of a group, so the ends of group 1 are the ends of all units: their number is ``n``
and both cut offsets are two of them. No unit is visited in Python.

Which units the cuts fall on and how the three parts are arranged depend on the row's id and
the seed alone, so reruns and other partitionings give the same rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drivegrid.llm.common import null_empty

#: A unit, with its leading white space, and the three markers. The possessive
#: forms match what the plain ones match; they only spare the matcher its way back.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _draws(row_id: str, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of the row."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(row_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def transform(df: DataFrame, row_id: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """One row per document: ``doc_id, n, form, prefix_chars, middle_chars, output``.

    ``rate`` per cent of the texts are cut into prefix, middle and suffix; of those, ``spm_rate``
    per cent come suffix first. Empty texts and texts that hold a marker stay plain, so every
    output can be turned back (``restored``). A null text is empty; a null id draws as an
    empty one. Rows are independent: repeated rows come as often as they are given, further
    columns are ignored, an empty table gives no rows. White space alone is one unit. A task
    holds about 100 bytes for each unit of one text at a time.
    """

    def run(batches):
        import regex

        units = regex.compile(f"({UNIT})*+")
        for pdf in batches:
            rows = [_cut(units, *row, rate, spm_rate) for row in pdf[["text", "h1", "h2", "h3", "h4"]].itertuples(index=False)]
            out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            out = out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64"))
            yield out

    rows = df.select(F.col(row_id).cast("long").alias("doc_id"), null_empty(text).alias("text"), *_draws(row_id, seed))
    return rows.mapInPandas(run, _OUT)


def _cut(units, text: str, h1: int, h2: int, h3: int, h4: int, rate: int, spm_rate: int) -> tuple:
    ends = units.fullmatch(text).ends(1)
    n = len(ends)
    if not text or h3 % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends[low - 1] if low else 0, ends[high - 1] if high else 0
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return n, "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def restored(output: str | Column, form: str | Column) -> Column:
    """The text again, from output and form alone. A transformed output holds each marker once:
    the text holds none, and a marker cannot begin inside another."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    after_s, after_p = F.substring_index(output, SUFFIX, -1), F.substring_index(output, PREFIX, -1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(F.substring_index(after_p, SUFFIX, 1), middle, F.substring_index(after_s, MIDDLE, 1))
    spm = F.concat(F.substring_index(after_p, MIDDLE, 1), middle, F.substring_index(after_s, PREFIX, 1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
