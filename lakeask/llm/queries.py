"""The queries of the ten operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, embeddings, exact_dedup, language, packing, quality, secrets, sharding, simhash, token_counts
from .common import crc_of_id


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = F.pmod(crc_of_id(F.col("doc_id")), F.lit(4)) == 2
    field = quality.train(docs, labels, ~out)
    scored = quality.score_quality(docs, field)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir))


def op3_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(_documents(spark, sf_dir))


def op4_hyperplane_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_bloom_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(_documents(spark, sf_dir), digests=True)


def op7_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    out = F.pmod(crc_of_id(F.col("doc_id")), F.lit(3)) == 1
    found = language.identify(docs, language.train(docs, ~out))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op8_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf_dir), 24)


def op9_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(_documents(spark, sf_dir), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["kind"] < 3)
    # The inner lambda has one parameter: Spark would hand a second one, k=k say, the place in the array.
    of_kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    number = [F.size(of_kind(k)).cast("long").alias(f"n_{secrets.KINDS[k]}") for k in range(3)]
    return found.select("row.doc_id", *number, F.sha2(secrets.span_text(base), 256).alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans"))


def op10_column_generation_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_quality_crf, op2_trie_token_counts, op3_simhash_pivots, op4_hyperplane_dedup, op5_bloom_dedup, op6_bpe_round_trip, op7_kneser_ney_language, op8_bounded_ring, op9_linked_secrets, op10_column_generation_packing)}

ORACLES = {
    "op5_bloom_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
}
