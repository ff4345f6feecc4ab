"""Registered queries of the operators for text corpora and the pipeline, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    bpe,
    exact_dup,
    fingerprints,
    html_text,
    lm,
    mixing,
    near_dup,
    negatives,
    pii,
    quality,
    spelling,
    substrings,
    toxicity,
)


def _table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def op1_bpe(spark: SparkSession, directory: str) -> DataFrame:
    return bpe.digests(_table(spark, directory, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_quality(spark: SparkSession, directory: str) -> DataFrame:
    return quality.quality(_table(spark, directory, "documents"), _table(spark, directory, "labels"))


def op3_html(spark: SparkSession, directory: str) -> DataFrame:
    return html_text.main_text(_table(spark, directory, "pages"))


def op4_substrings(spark: SparkSession, directory: str) -> DataFrame:
    left = substrings.without_repeats(_table(spark, directory, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_mixing(spark: SparkSession, directory: str) -> DataFrame:
    mix = mixing.mix_sizes(_table(spark, directory, "documents"))
    return mix.select("doc_id", "source", "size", "source_size", "target", "taken")


def op6_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, directory, "documents"), _table(spark, directory, "labels"))


def op7_near_dup(spark: SparkSession, directory: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, directory, "documents"))


def op8_pii(spark: SparkSession, directory: str) -> DataFrame:
    found = pii.personal_data(_table(spark, directory, "documents"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans"
    )


def op9_exact_dup(spark: SparkSession, directory: str) -> DataFrame:
    return exact_dup.exact_groups(_table(spark, directory, "documents"))


def op10_fingerprints(spark: SparkSession, directory: str) -> DataFrame:
    made = fingerprints.edited_fingerprints(_table(spark, directory, "documents"))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


def op11_hard_negatives(spark: SparkSession, directory: str) -> DataFrame:
    return negatives.hard_negatives(_table(spark, directory, "embeddings"))


def op12_lm(spark: SparkSession, directory: str) -> DataFrame:
    return lm.scores(_table(spark, directory, "documents"))


def op13_spelling(spark: SparkSession, directory: str) -> DataFrame:
    return spelling.variants(_table(spark, directory, "documents"))


def pipeline(spark: SparkSession, directory: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, directory)


QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe,
        op2_quality,
        op3_html,
        op4_substrings,
        op5_mixing,
        op6_toxicity,
        op7_near_dup,
        op8_pii,
        op9_exact_dup,
        op10_fingerprints,
        op11_hard_negatives,
        op12_lm,
        op13_spelling,
        pipeline,
    )
}

SQL = {
    "op4_substrings": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, k, array_to_string(w[k : k + 12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM words)),
repeats AS (
  SELECT doc_id, k FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS least FROM windows) WHERE least < doc_id),
gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(k, k + 13)) AS p FROM repeats) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN ps IS NULL THEN array_to_string(w, ' ')
              ELSE coalesce(array_to_string([w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(ps, i)], ' '), '') END) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id)
""",
    "op5_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
  FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3.0 * sum(size) AS most,
         [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER before, 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM totals
  WINDOW before AS (ORDER BY most / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aims AS (
  SELECT source, source_size, least(most, coalesce(weight * max(CASE WHEN level * weight <= most THEN level END) OVER (), most)) AS target
  FROM levels),
wanted AS (
  SELECT s.*, a.source_size, a.target, CASE WHEN a.source_size > 0 THEN least(3.0, a.target / a.source_size) ELSE 0.0 END AS w
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source),
keyed AS (
  SELECT *, floor(w) AS whole, w - floor(w) AS p,
         CASE WHEN w > floor(w) THEN (u / (1 - u)) / ((w - floor(w)) / (1 - (w - floor(w)))) END AS rank
  FROM wanted),
ranked AS (
  SELECT *, CASE WHEN rank IS NOT NULL THEN rank / (1 + rank) ELSE 1.0 END AS key FROM keyed),
summed AS (
  SELECT *, target - sum(whole * size) OVER (PARTITION BY source) AS rest,
         CASE WHEN key < 1 THEN sum(CASE WHEN key < 1 THEN size ELSE 0 END)
           OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) END AS total
  FROM ranked),
gaps AS (
  SELECT *, min(CASE WHEN total > rest THEN rest - total + size END)
         FILTER (total > rest AND before_cut) OVER (PARTITION BY source) AS gap
  FROM (SELECT *, total - size <= rest AND total > rest AND
               row_number() OVER (PARTITION BY source, total > rest ORDER BY key, doc_id, size) = 1 AS before_cut FROM summed)),
fills AS (
  SELECT *, CASE WHEN total > rest AND size > 0 AND size <= gap THEN
         row_number() OVER (PARTITION BY source, total > rest AND size > 0 AND size <= gap ORDER BY size DESC, key, doc_id) END AS place
  FROM gaps)
SELECT doc_id, source, size, source_size, target,
       (size * (whole + CASE WHEN total <= rest OR place = 1 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM fills
""",
    "op9_exact_dup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       coalesce(doc_id = max(doc_id) OVER g, max(doc_id) OVER g IS NULL) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS place
  FROM scores WHERE same),
negatives AS (
  SELECT p.anchor_id, positive_id, positive_score, s.other AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other) AS rank
  FROM positives p JOIN scores s USING (anchor_id)
  WHERE place <= 5 AND NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 10
""",
}
