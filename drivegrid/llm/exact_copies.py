"""Exact duplicate removal in native expressions, safe for very large groups of copies.

Texts are equal when they are identical after the six ASCII white-space characters are
deleted. Copies are combined in three stages, and every stage groups by the whole normalised
text beside its SHA-256, so nothing is merged on a digest alone:

1. locally: the partial aggregation of the first grouping leaves one row per text and task;
2. salted: groups of (digest, text, salt) are merged, so one text spreads over ``salts`` tasks;
3. globally: the winners of the salts, at most ``salts`` rows per text, are combined.

The winner (most code points in the original text, then smallest id) travels as one decimal,
which keeps the aggregations hash-based. Members then meet their winner on the digest; stage 3
has shown by then that a digest stands for one text (two texts under one SHA-256 raise an error).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drivegrid.llm.common import free_names, null_empty, written

#: The white space that does not count.
WHITE_SPACE = " \t\n\x0b\x0c\r"

_ID_SPAN = "40000000000000000000"  # more than twice the ids a long can hold
_TOP = "9223372036854775808"


def normalised(text: str) -> Column:
    return F.translate(null_empty(text), WHITE_SPACE, "")


def _rank(text: str, row_id: str) -> Column:
    """Longest text first, then smallest id; a null id comes last."""
    size = F.length(null_empty(text)).cast("decimal(10,0)") * F.lit(_ID_SPAN).cast("decimal(20,0)")
    return (size + F.coalesce(F.lit(_TOP).cast("decimal(20,0)") - F.col(row_id).cast("decimal(20,0)"), F.lit(0))).cast("decimal(38,0)")


def _winners(df: DataFrame, row_id: str, text: str, salts: int) -> DataFrame:
    rows = df.select(
        normalised(text).alias("content"),
        F.pmod(F.xxhash64(row_id), F.lit(salts)).alias("salt"),
        _rank(text, row_id).alias("rank"),
    ).withColumn("digest", F.unhex(F.sha2("content", 256)))
    salted = rows.groupBy("digest", "content", "salt").agg(F.count("*").alias("n"), F.max("rank").alias("rank"))
    merged = salted.groupBy("digest", "content").agg(F.sum("n").alias("n"), F.max("rank").alias("rank"))
    # one row per digest without its text; a second text under the digest stops the job
    per = merged.groupBy("digest").agg(F.count("*").alias("texts"), F.sum("n").alias("group_size"), F.max("rank").alias("rank"))
    alone = F.when(F.col("texts") == 1, F.col("rank")).otherwise(F.raise_error(F.lit("two texts share a SHA-256")).cast("decimal(38,0)"))
    part = (alone % F.lit(_ID_SPAN).cast("decimal(20,0)")).cast("decimal(20,0)")
    keep = F.when(part > 0, F.lit(_TOP).cast("decimal(20,0)") - part).cast("long")
    return written(per.select("digest", "group_size", keep.alias("keep_id")))


def exact_copies(df: DataFrame, row_id: str = "doc_id", text: str = "text", salts: int = 16) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    A null text counts as empty. Rows with a null id are counted in their group and are kept
    only if no member has an id (``keep_id`` is then null). Rows that repeat the winner's id
    with an equal text are the same document and are all marked as kept; ``keep_one`` leaves
    one of them. An empty table gives no rows; further columns are ignored.
    """
    winners = _winners(df, row_id, text, salts)
    rows = df.select(F.col(row_id).cast("long").alias("doc_id"), F.sha2(normalised(text), 256).alias("text_sha256"))
    return (
        rows.withColumn("digest", F.unhex("text_sha256"))
        .join(winners, "digest", "left")
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )


def keep_one(df: DataFrame, row_id: str = "doc_id", text: str = "text", salts: int = 16) -> DataFrame:
    """The rows of ``df`` that win their group, with all their columns, one row per text."""
    digest, rep, won_digest, won_id = free_names(df, "_digest", "_rep", "_won_digest", "_won_id")
    winners = _winners(df, row_id, text, salts).select(F.col("digest").alias(won_digest), F.col("keep_id").alias(won_id))
    won = df.withColumn(digest, F.unhex(F.sha2(normalised(text), 256))).join(
        winners, (F.col(digest) == F.col(won_digest)) & F.col(row_id).eqNullSafe(F.col(won_id)), "left_semi"
    )
    repeated = written(df.groupBy(row_id).agg(F.count("*").alias(won_id)).filter(F.col(won_id) > 1).select(F.col(row_id).alias(rep)))
    if repeated.isEmpty():  # only ids are read; no text moves again when ids are unique
        return won.drop(digest)
    same = F.col(row_id).eqNullSafe(F.col(rep))
    return won.join(repeated, same, "left_anti").unionByName(won.join(repeated, same, "left_semi").dropDuplicates([digest])).drop(digest)
