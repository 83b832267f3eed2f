"""The queries of this subpackage, bound to the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm import automata, leaks, licenses, manifest, ngrams, packing, pii, quality, sharding, simplex, snapshots, suffixes, toxicity
from voxlake.llm.tables import documents, vocabulary
from voxlake.sources.tables import load

Query = Callable[[SparkSession, str], DataFrame]


def op1_substring_automata(spark: SparkSession, folder: str) -> DataFrame:
    cut = automata.remove_earlier_passages(documents(spark, folder), span=50, keep_text=False)
    return cut.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "kept_sha256", "n_spans")


def op2_noisy_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, toxicity.learn_toxicity(docs, load(spark, folder, "labels")), "score")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_suffix_repeats(spark: SparkSession, folder: str) -> DataFrame:
    cut = suffixes.remove_repeated_bytes(documents(spark, folder), span=400, keep_text=False)
    return cut.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def op4_byte_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_by_bytes(documents(spark, folder), shards=40, overhead=16)


def op5_quality_trees(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return quality.rate_quality(docs, quality.fit_quality(docs, load(spark, folder, "labels")))


def op6_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.find_leaks(documents(spark, folder), load(spark, folder, "benchmark"))


def op7_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngrams.near_duplicates(documents(spark, folder), percent=80, n=5).select("doc_id", "n_shingles", "component_id")


def op8_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.best_fit_packing(documents(spark, folder), vocabulary("word_bpe_49k.json"), length=4096, end_id=1)


def op9_license_templates(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan_licenses(documents(spark, folder))
    at = F.transform("places", lambda p: p["word"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base, own = F.transform("places", lambda p: p["label"]), F.transform("spans", lambda s: s["label"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, own)).alias("labels"),
        F.when(F.size("spans") > 0, 1.0).when(F.size("places") > 0, 0.5).otherwise(0.0).alias("score"),
    )


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_pii(documents(spark, folder).select("doc_id", "text"))
    of = lambda kind: F.filter("pii", lambda s: s["kind"] == kind)
    base = F.filter("pii", lambda s: s["kind"].isin(pii.BASE))
    return found.select(
        "doc_id",
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in pii.BASE],
        F.sha2(pii.written(base), 256).alias("base_sha256"),
        pii.written(F.col("pii")).alias("spans"),
        F.size(of("iban")).cast("long").alias("n_iban"),
        F.aggregate("pii", F.lit(0.0), lambda a, s: F.greatest(a, s["score"])).alias("max_score"),
    )


def op11_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.exact_duplicates(documents(spark, folder), batches=3).drop("first_batch")


def op12_simplex_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return simplex.centroid_clusters(load(spark, folder, "embeddings"), clusters=8, rounds=10, size=64).drop("compared")


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return manifest.merkle_manifest(documents(spark, folder), tampered).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def llm_queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_substring_automata, op2_noisy_toxicity, op3_suffix_repeats, op4_byte_shards, op5_quality_trees, op6_benchmark_leaks, op7_ngram_jaccard, op8_best_fit_packing, op9_license_templates, op10_pii, op11_exact_dedup, op12_simplex_clusters, op13_merkle_manifest)}


def llm_oracles() -> dict[str, str]:
    """SQL for what DuckDB can say; the others learn models, need look-around in patterns, checksums or bytes, and are
    tested against brute force in tests/llm."""
    return {"op1_substring_automata": automata.SQL, "op4_byte_shards": sharding.sql(), "op6_benchmark_leaks": leaks.SQL, "op7_ngram_jaccard": ngrams.SQL, "op11_exact_dedup": snapshots.SQL, "op12_simplex_clusters": simplex.sql(), "op13_merkle_manifest": manifest.sql()}
