"""Corpus pipeline: language ID, exact dedup, SimHash near-dedup, secret scans, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeask.llm import exact_dedup, language, packing, secrets, simhash
from lakeask.llm.common import crc_of_id, discard, join_groups, scratch, stage, with_row_key

#: SQL can't express the language models, fingerprints and packing; tests hold run() against a brute-force version.
ORACLE_SQL = None
#: Most row keys (a file's name and a number each) of dropped documents that are broadcast; more meet the documents by a shuffle.
BROADCAST_KEYS = 1 << 17


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models accept. Models learn from rows as in op7; the rest of the row goes along."""
    models = language.train(docs, F.pmod(crc_of_id(F.col("doc_id")), F.lit(3)) != 1)
    found = language.identify(docs, models, carry=docs.columns)
    return found.filter("not rejected").select("carried.*")


def _free_name(docs: DataFrame) -> str:
    name = "row_key_"
    while name in docs.columns:
        name += "_"
    return name


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one row with the largest doc_id, nulls below all others; of several such rows, the last of the table."""
    key = _free_name(docs)
    rows = with_row_key(docs, key)
    found = exact_dedup.exact_dedup(rows.withColumn(key, F.struct("doc_id", f"{key}.file", f"{key}.row")), key)
    return found.filter("kept").select(*[F.col(f"row.`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the one row with the smallest doc_id, nulls after all others; of several such rows, the first of
    the table. Rows are told apart by their place in the table, so ids may be null or used again."""
    key = _free_name(docs)
    rows = with_row_key(docs, key)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", f"{key}.file", f"{key}.row")
    prints = simhash.fingerprints(rows.select(rank.alias("id"), "text"), "id")
    reps = simhash.representatives(prints)
    found = join_groups(prints, simhash.fingerprint_components(reps), reps, ["fp"], "id")
    gone = stage(found.filter(~F.col("id").eqNullSafe(F.col("component"))).select(F.struct("id.file", "id.row").alias(key)), "gone")
    if gone.count() <= BROADCAST_KEYS:
        gone = F.broadcast(gone)
    return rows.join(gone, key, "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every finding replaced in the text and n_chars counted anew."""
    found = secrets.scan_secrets(docs)
    text = secrets.redact(F.col("row.text"), F.col("spans"))
    changed = F.size("spans") > 0
    new = {"text": text, "n_chars": F.when(changed, F.length(text).cast("long")).otherwise(F.col("row.n_chars"))}
    return found.select(*[new.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scans", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; a stage's own tables, and its input, are deleted when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        with scratch(spark):
            result = stage(function(spark, docs, sf_dir), name, keep=True)
        discard(docs)
        docs = result
    return STAGES[-1][1](spark, docs, sf_dir)
