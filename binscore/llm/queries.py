"""The ``opN_*`` queries: each applies its operator to the whole table with
production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binscore.llm import (bpe, centroids, class_lm, licences, mixing, periodic, pii, quality_model, quality_rules, simhash,
                          sketches, token_counts, toxicity)
from binscore.llm.common import documents, prepare
from binscore.llm.registry import ORACLE, QUERIES, query  # noqa: F401
from binscore.sources.tables import read_table

MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, 3 * source_size AS cap,
         (sum(source_size) OVER () * 1.0::DOUBLE
          - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, encode(source) NULLS LAST
                                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(weight) OVER ()
            - coalesce(sum(weight) OVER (ORDER BY 3 * source_size / weight, encode(source) NULLS LAST
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM s),
m AS (SELECT arg_min(level, cap / weight) AS level FROM l WHERE level * weight <= cap),
t AS (
  SELECT l.source, source_size, least(cap::DOUBLE, coalesce(m.level * weight, cap::DOUBLE)) AS target
  FROM l, m),
e AS (
  SELECT *, floor(target + 0.5)::BIGINT AS goal,
         CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs
  FROM t),
r AS (
  SELECT d.doc_id, d.source, d.size, source_size, target, epochs, goal - epochs * source_size AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS place
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, size, source_size, target,
       (epochs * size + greatest(0, least(size, rest - (place - size))))::BIGINT AS taken
FROM r
"""


@query("op1_mix_sources", MIX_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir, "doc_id", "source", "text"))


@query("op10_simhash_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query("op2_byte_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.encode(documents(spark, sf_dir, "doc_id", "text"), path), path)


@query("op9_quality_trees")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_model.score_documents(documents(spark, sf_dir, "doc_id", "text"), read_table(spark, sf_dir, "labels"))
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op3_toxic_segments")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score_documents(documents(spark, sf_dir, "doc_id", "text"), read_table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages")


@query("op6_quality_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir, "doc_id", "lang", "text"))


@query("op5_personal_data")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.personal_data(documents(spark, sf_dir, "doc_id", "text")))


@query("op4_class_ngrams")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score_documents(documents(spark, sf_dir, "doc_id", "text"))


@query("op8_scaled_sketches")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sketches.fingerprints(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                        sketches.as_text(F.col("kept")).alias("fingerprint"),
                        sketches.as_text(F.col("edited_kept")).alias("edited_fingerprint"), "near_edited", "near_next")


@query("op7_licence_scan", licences.sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(licences.document_paths(documents(spark, sf_dir, "doc_id", "source", "text")))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.find_runs(periodic.with_periods(documents(spark, sf_dir, "doc_id", "text"))))


@query("op12_token_counts")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op13_centroid_clusters", centroids.sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    rows, facts, _ = centroids.ns_cluster(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]), k=40, rounds=5)
    return centroids.with_inertia(rows, facts)
