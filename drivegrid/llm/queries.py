"""The registered queries of the training-data operators and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drivegrid.llm import (
    exact_copies,
    hard_negatives,
    infilling,
    jaccard_join,
    languages,
    licenses,
    maxent,
    mixing,
    packing,
    quality_rules,
    shards,
    vector_links,
    wrappers,
)
from drivegrid.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn

    return register


@query("op1_scan_licenses")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_notices", "n_tags", "license_class")


@query("op2_identify_language")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = languages.fit(docs.filter(~languages.held_out("doc_id")))
    found = languages.predict(docs, model)
    return found.select("doc_id", languages.held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query("op3_link_vectors")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.link_vectors(read(spark, sf_dir, "embeddings"))


@query("op4_shard_documents")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(read(spark, sf_dir, "documents"))


@query(
    "op5_exact_copies",
    r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t, length(coalesce(text, '')) AS c FROM documents),
w AS (SELECT doc_id, t, first_value(doc_id) OVER (PARTITION BY t ORDER BY c DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM w""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies.exact_copies(read(spark, sf_dir, "documents"))


@query("op6_near_copies")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_copies(read(spark, sf_dir, "documents"))


@query("op7_mix_sources")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(read(spark, sf_dir, "documents"))
    repeats = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows")))
    return plan.withColumn("_nth", repeats).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source"
    )


@query("op8_extract_pages")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(read(spark, sf_dir, "pages"))


@query("op9_pack_documents")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


@query("op10_score_documents")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(read(spark, sf_dir, "documents"), languages.held_out("doc_id", 7))


@query("op11_judge_quality")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, read(spark, sf_dir, "labels")))


@query(
    "op12_fill_in_middle",
    r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS s FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
  ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
n AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM u),
p AS (SELECT doc_id, t, n, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:], '') AS suf,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM n)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infilling.transform(read(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(infilling.restored("output", "form"), 256).alias("restored_sha256"),
    )


@query(
    "op13_hard_negatives",
    """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY rank <= 10""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)
