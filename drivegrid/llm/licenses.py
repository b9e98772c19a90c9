"""Licence scan: Aho-Corasick for identifier tags and notice phrases, and a shunting-yard
evaluation of licence expressions.

A text is lower-cased (A-Z) and cut into words; one automaton over the space-joined words finds
all notice phrases in one pass, whatever their number, and reports each place as a word number.
A second automaton finds identifier tags in the raw text; the expression behind a tag
(``MIT OR (Apache-2.0 WITH LLVM-exception AND ISC)``) is parsed by precedence with > and > or and
evaluated over licence classes: *and* takes the strictest operand, *or* the most permissive one,
*with* relaxes a copyleft licence by one step.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drivegrid.llm.common import null_empty

#: The base phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Further notice phrases and their labels.
NOTICE_PHRASES = {
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "cc by nc": "cc-by-nc",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by 4 0": "cc-by",
    "cc by 3 0": "cc-by",
    "cc0 1 0": "cc0",
    "creative commons attribution": "cc-by",
    "public domain dedication": "public-domain",
    "all rights reserved": "all-rights-reserved",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
}

#: Tags that an identifier or expression follows in the raw text.
TAGS = ("spdx-license-identifier:", "license-expression:")

#: 0 free, 1 permissive, 2 weak copyleft, 3 strong copyleft, 4 non-commercial or no licence.
CLASSES = {
    "cc0": 0, "public-domain": 0, "unlicense": 0, "mit": 1, "apache": 1, "bsd": 1, "isc": 1, "cc-by": 1, "mpl": 2, "epl": 2,
    "lgpl": 2, "cc-by-sa": 2, "gpl": 3, "agpl": 3, "cc-by-nd": 4, "cc-by-nc": 4, "cc-by-nc-sa": 4, "cc-by-nc-nd": 4, "all-rights-reserved": 4,
}
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_LOWER_ASCII = {c: c + 32 for c in range(65, 91)}
_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+-]*)")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_VERSION = re.compile(r"-?v?\d+(\.\d+)*(-clause)?(-only|-or-later)?\+?$")


def words_of(text: str) -> bytes:
    """The words of a text, lower-cased, joined by single spaces."""
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split())


def label_of(identifier: str) -> str:
    """``Apache-2.0`` -> ``apache``: the identifier without its version."""
    low = identifier.lower()
    if low.startswith("cc0"):
        return "cc0"
    return _VERSION.sub("", low) or low


def parse_expression(text: str, at: int = 0, end: int | None = None) -> tuple[list[str], int | None] | None:
    """Labels and class of the longest licence expression at ``at`` (up to ``end``); None if
    there is none. A class is None when an identifier is not known."""
    output: list[tuple[tuple[str, ...], int | None]] = []
    stack: list[str] = []
    good = None
    wants_name, depth = True, 0
    end = len(text) if end is None else end
    while match := _TOKEN.match(text, at, end):
        token = match[1]
        low = token.lower()
        if low == "(" and wants_name:
            stack.append(low)
            depth += 1
        elif low == ")" and not wants_name and depth:
            while stack[-1] != "(":
                _apply(output, stack.pop())
            stack.pop()
            depth -= 1
        elif low in _PRECEDENCE and not wants_name:
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[low]:
                _apply(output, stack.pop())
            stack.append(low)
            wants_name = True
        elif low not in _PRECEDENCE and low not in "()" and wants_name:
            bare = token.rstrip(".")
            if stack and stack[-1] == "with":
                output.append(((), 0))
            else:
                name = label_of(bare)
                output.append(((name,), CLASSES.get(name)))
            wants_name = False
        else:
            break
        at = match.end()
        if not wants_name and not depth:
            good = (list(output), list(stack))
    if good is None:
        return None
    output, stack = good
    while stack:
        _apply(output, stack.pop())
    names, rank = output[0]
    return sorted(set(names)), rank


def _apply(output: list, operator: str) -> None:
    right, left = output.pop(), output.pop()
    names = left[0] + right[0]
    if operator == "with":
        rank = left[1] - 1 if left[1] in (2, 3) else left[1]
    elif left[1] is None or right[1] is None:
        rank = None if operator == "and" else left[1] if right[1] is None else right[1]
    else:
        rank = max(left[1], right[1]) if operator == "and" else min(left[1], right[1])
    output.append((names, rank))


class Scanner:
    """Both automata; built once per task."""

    def __init__(self, base: dict[str, str], notices: dict[str, str], tags: Iterable[str]):
        import ahocorasick

        self._phrases, self._tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        entries: dict[str, list[tuple[bool, str, int]]] = {}
        for is_base, table in ((True, base), (False, notices)):
            for phrase, label in table.items():
                entries.setdefault(f" {phrase} ", []).append((is_base, label, len(phrase)))
        for key, found in entries.items():
            self._phrases.add_word(key, found)
        for tag in tags:
            self._tags.add_word(tag, tag)
        self._phrases.make_automaton()
        self._tags.make_automaton()

    def scan(self, text: str) -> dict:
        words = words_of(text)
        line = f" {words.decode('latin-1')} " if words else ""
        n_words = line.count(" ") - 1 if line else 0
        starts, base, all_labels, spans = [], set(), set(), []
        counted = blanks = 0  # blanks are counted on from the hit before
        for end, found in self._phrases.iter(line):
            blanks += line.count(" ", counted, end)
            counted = end
            for is_base, label, length in found:
                inner = line.count(" ", end - length, end)
                start = blanks - inner - 1
                spans.append((start, start + 1 + inner, label, is_base))
                all_labels.add(label)
                if is_base:
                    base.add(label)
                    starts.append(start)
        rank, tagged, line_end = None, 0, -1
        for end, _ in self._tags.iter(text.translate(_LOWER_ASCII)):
            if line_end < end:
                line_end = text.find("\n", end)
                line_end = line_end if line_end >= 0 else len(text)
            parsed = parse_expression(text, end + 1, line_end)
            if parsed:
                tagged += 1
                all_labels.update(parsed[0])
                rank = parsed[1] if rank is None or parsed[1] is None else max(rank, parsed[1])
        # a tag is certain; notices count more the more there are of them
        score = 1.0 if tagged else 1.0 - 0.5 ** len(spans)
        return {
            "n_words": n_words, "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(all_labels)), "score": score,
            "n_notices": len(spans), "n_tags": tagged, "license_class": rank, "spans": sorted(spans),
        }


_SCAN = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "n_notices long, n_tags long, license_class int, spans array<struct<first:long,after:long,label:string,base:boolean>>"
)


def scan(df: DataFrame, row_id: str = "doc_id", text: str = "text", base: dict[str, str] = BASE_PHRASES, notices: dict[str, str] = NOTICE_PHRASES, tags: Iterable[str] = TAGS) -> DataFrame:
    """One row per document with every notice (``spans``: first word, word after, label) and
    the class of its tagged expressions.

    A null text is empty: no words, empty label strings, score 0. Rows are independent, so
    repeated rows and null ids are returned as they come; further columns are ignored; an
    empty table gives no rows. All places of a phrase count, overlapping ones too.
    """
    tags = tuple(tags)

    def run(batches):
        scanner = Scanner(base, notices, tags)
        for pdf in batches:
            out = pd.DataFrame([scanner.scan(t) for t in pdf["text"]], columns=_COLUMNS)
            for c in ("first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            out["license_class"] = out["license_class"].astype("Int32")
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy(dtype=object))
            yield out.astype({"doc_id": "Int64"})

    return df.select(F.col(row_id).cast("long").alias("doc_id"), null_empty(text).alias("text")).mapInPandas(run, _SCAN)


_COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_notices", "n_tags", "license_class", "spans"]
