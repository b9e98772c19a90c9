"""Corpus preparation as a sequence of stages, each written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from drivegrid.llm import exact_copies, jaccard_join, languages, mixing, packing
from drivegrid.llm.common import read, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: A text stays when at least this share of its letters is in known languages, however many.
MIN_SHARE = 0.5


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or with less than half of their letters in known languages, go.

    The decision is a column of the text itself, so no text is shuffled."""
    model = languages.fit(docs.filter(~languages.held_out("doc_id")))
    return languages.filter_texts(docs, model, MIN_SHARE)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_copies.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (word 5-grams, Jaccard 0.8)."""
    return jaccard_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target weights."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in a training sequence."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", keep_known_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Learned labels, signatures and tokenisation have no SQL form; tests use brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
