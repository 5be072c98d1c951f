"""Schema linking: rank columns for a question, add must-have columns from values, widen in tiers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lakeask.functions.text import characters, jaccard, match_form

K = 6

#: A scorer turns question and column description into a score; the lexical one stands in for a trained ranker.
Scorer = Callable[[Column, Column], Column]


def lexical_score(question: Column, description: Column) -> Column:
    """Character-set Jaccard of the match forms."""
    return jaccard(characters(match_form(question)), characters(match_form(description)))


def rank_columns(questions: DataFrame, metadata: DataFrame, score: Scorer = lexical_score) -> DataFrame:
    """(question_id, column_name, score, rank): every question against every column. The metadata is one row per column of a
    schema - bounded by it, not by the data - and is broadcast."""
    scored = questions.join(F.broadcast(metadata), F.lit(True)).select("question_id", "column_name", F.round(score(F.col("question"), F.col("column_description")).cast("decimal(20,10)"), 6).cast("double").alias("score"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("score"), "column_name")))


def must_have(exact: DataFrame, fuzzy: DataFrame) -> DataFrame:
    """(question_id, column_name) of all columns that hold a keyword exactly or nearly."""
    return exact.select("question_id", "column_name").union(fuzzy.select("question_id", "column_name")).distinct()


def tier(ranked: DataFrame, required: DataFrame, number: int, k: int = K) -> DataFrame:
    """Columns of a tier with the must-have ones: 1 has ranks 1..k, 2 has 1..2k, 3 has 2k+1..3k; ordered by rank."""
    low, high = {1: (1, k), 2: (1, 2 * k), 3: (2 * k + 1, 3 * k)}[number]
    wanted = ranked.filter(F.col("rank").between(low, high)).select("question_id", "column_name").union(required.select("question_id", "column_name")).distinct()
    return wanted.join(ranked, ["question_id", "column_name"], "left").select("question_id", "column_name", "rank")


def tiers(ranked: DataFrame, required: DataFrame, k: int = K) -> DataFrame:
    """(question_id, tier, columns): the three tiers' column names joined by commas, in name order."""
    out = None
    for number in (1, 2, 3):
        part = tier(ranked, required, number, k).groupBy("question_id").agg(F.array_join(F.sort_array(F.collect_list("column_name")), ",").alias("columns")).withColumn("tier", F.lit(number))
        out = part if out is None else out.unionByName(part)
    return out.select("question_id", "tier", "columns")


def selector_listing(metadata: DataFrame, columns: list[str], examples: int = 2) -> str:
    """Prompt text of candidate columns with their first examples; metadata has column_name, column_description and examples."""
    found = {r["column_name"]: r for r in metadata.filter(F.col("column_name").isin(columns)).collect()}
    lines = [f"- {c}: {found[c]['column_description']} (Ex: {', '.join((found[c]['examples'] or [])[:examples])})" for c in columns if c in found]
    return "\n".join(["[Schema Candidates]", *lines])


def schema_prompt(metadata: DataFrame, columns: list[str], inline: DataFrame | None = None, database: str = "db", table: str = "t", shuffle: str | None = None) -> str:
    """Prompt text of the known columns, in the given order or one drawn by the seed `shuffle`, so that a model doesn't learn
    places; unknown ones are left out. Bounded by the schema's width."""
    columns = columns if shuffle is None else sorted(columns, key=lambda c: hashlib.md5(f"{c}{shuffle}".encode()).digest())
    rows = metadata.filter(F.col("column_name").isin(columns))
    rows = rows.join(inline.withColumnRenamed("column", "column_name"), "column_name", "left") if inline is not None else rows.withColumn("inline", F.lit(None).cast("string"))
    found = {r["column_name"]: r for r in rows.collect()}
    lines = [f"({c}, {found[c]['column_description']}" + (f" [{found[c]['inline']}]" if found[c]["inline"] else "") + ")" for c in columns if c in found]
    return "\n".join([f"[DB_ID] {database}", f"# Table: {table}", "[", ",\n".join(lines), "]"])


def evidence_text(evidence: DataFrame) -> DataFrame:
    """(question_id, text) of rows (question_id, keyword, column_name, value)."""
    line = F.format_string("%s: %s = %s", "keyword", "column_name", "value")
    return evidence.groupBy("question_id").agg(F.array_join(F.sort_array(F.collect_set(line)), "\n").alias("text"))
