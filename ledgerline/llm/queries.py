"""One registered query for each training-data operator: production parameters over the whole intended tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, minhash, mixing, nndescent, packing, periodic, pii, quality, substrings, tiers, topk, toxicity, whitening
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    out = toxicity.score(docs, labels)
    return out.select("doc_id", (toxicity.fold(F.col("doc_id")) == 0).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 largest inner products of each vector whose id is divisible by 20."""
    vectors = topk.quantized(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, vectors.where("vec_id % 20 = 0"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and class_id (the smallest doc_id of its near-duplicates) of every document."""
    return minhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    out = substrings.clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, domain, lang, source, tokens, copies of every document that the mix takes."""
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")).drop("text")


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 10 nearest vectors found for each vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nndescent.Index(vectors).search(vectors.where("vec_id % 100 = 0"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, digest, n_matches, licenses of every document."""
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, log_weight, key of the sampled documents."""
    return quality.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of base spans by kind, their digest, and all spans of every document."""
    found = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2(pii.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every vector and its first four components."""
    out = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.select("vec_id", "component", "n", F.col("deviation").cast("long").alias("deviation"), "whitened", "explained", "identity_error")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, the strongest run, digests of all runs and of the collapsed text of every document."""
    found = periodic.detect(periodic.planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = found.withColumn("best", periodic.strongest(F.col("runs")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    strongest = [F.col("best")[k].alias(k) for k in ("start", "length", "period")] + [F.expr("best.length * 1000 div best.period").alias("exponent_milli")]
    return best.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *strongest, digest(periodic.listed(F.col("runs"))).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))


def op13_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group of every piece of every document."""
    return tiers.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_topk_search": op2_topk_search,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_nn_descent": op6_nn_descent,
    "op7_license_scan": op7_license_scan,
    "op8_quality_resampling": op8_quality_resampling,
    "op9_pii": op9_pii,
    "op10_mixing": op10_mixing,
    "op11_whitening": op11_whitening,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_tiered_packing": op13_tiered_packing,
}
SUBSTRINGS_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM w WHERE len(w) >= 20),
o AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i : i + 19], ' ') ORDER BY doc_id, i) AS r FROM p),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM o WHERE r > 1),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM w),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM u ANTI JOIN c USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
ORACLES: dict[str, str] = {
    "op2_topk_search": topk.ORACLE,
    "op5_substring_dedup": SUBSTRINGS_SQL,
    "op7_license_scan": licenses.oracle(),
    "op10_mixing": mixing.ORACLE,
}
