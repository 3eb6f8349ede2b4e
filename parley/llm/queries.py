"""Registered queries of the language-model operators and the SQL of those it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import (
    centroids,
    decontamination,
    hard_negatives,
    html_text,
    language,
    packing,
    personal,
    quality,
    repeats,
    secrets,
    simhash,
    token_files,
    toxicity,
)
from parley.llm.shared import crc32_in_place_of, shared_folder

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.report(documents, items)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crc32_in_place_of(packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, end_id=1), "ids")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, TOKENIZER, end_id=2)
    return token_files.digest(token_files.read_tokens(spark, path))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.digest(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = hard_negatives.shifted_label(F.col("label"), every=7, classes=10)
    return hard_negatives.mine(vectors.withColumn("label", label), anchors_every=50)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, scale=64)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_packing": op2_packing,
    "op3_simhash": op3_simhash,
    "op4_secrets": op4_secrets,
    "op5_token_files": op5_token_files,
    "op6_language": op6_language,
    "op7_quality": op7_quality,
    "op8_toxicity": op8_toxicity,
    "op9_repeats": op9_repeats,
    "op10_html": op10_html,
    "op11_personal": op11_personal,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_centroids": op13_centroids,
}

FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
HARD_NEGATIVES_SQL = f"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {FINITE}),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label,
         list_dot_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score
  FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label
  AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""


def centroids_sql(k: int = 16, rounds: int = 3) -> str:
    """K-means with the rounds written out one after the other."""
    steps = [
        f"""k AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) AS n, vec_id,
         list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND {FINITE})""",
        f"c0 AS (SELECT (n - 1)::INTEGER AS cluster, v FROM k WHERE n <= {k})",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS (
  SELECT n, vec_id, k.v, cluster,
         list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c{i}.v[i]) * (k.v[i] - c{i}.v[i])))::BIGINT AS distance
  FROM k, c{i} QUALIFY row_number() OVER (PARTITION BY n ORDER BY distance, cluster) = 1)"""
        )
        if i < rounds:
            steps.append(
                f"""d{i} AS (
  SELECT cluster, i, sum(x) AS s, count(*) AS m
  FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY ALL),
m{i} AS (
  SELECT cluster, list(((s - ((s % m) + m) % m) // m)::BIGINT ORDER BY i) AS v FROM d{i} GROUP BY cluster),
c{i + 1} AS (SELECT cluster, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (cluster))"""
            )
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} AS c USING (cluster)"""


ORACLES: dict[str, str] = {
    "op12_hard_negatives": HARD_NEGATIVES_SQL,
    "op13_centroids": centroids_sql(),
}
