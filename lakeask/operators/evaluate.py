"""Scores of answers and rankings, and the loop that asks a system a test set."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from lakeask.functions.text import cell_text, truth_items


def same_answer(truth: Column, predicted: Column) -> Column:
    """Are two listed answers the same set of canonical texts?"""
    return truth_items(truth) == truth_items(predicted)


def accuracy(answers: DataFrame, by: list[str] = ()) -> DataFrame:
    """total, correct, accuracy and mean figures of answers (truth, predicted, total_s, first_s, repair_s array); no answer: 0."""
    right = F.coalesce(same_answer(F.col("truth"), F.col("predicted")), F.lit(False)).cast("int")
    repairs = F.sum(F.size("repair_s"))
    return answers.groupBy(*by).agg(
        F.count("*").alias("total"), F.coalesce(F.sum(right), F.lit(0)).alias("correct"), F.coalesce(F.avg(right), F.lit(0.0)).alias("accuracy"), F.coalesce(F.avg("total_s"), F.lit(0.0)).alias("mean_total_s"),
        F.coalesce(F.avg("first_s"), F.lit(0.0)).alias("mean_first_s"), F.coalesce(repairs, F.lit(0)).alias("repairs"),
        F.coalesce(F.sum(F.aggregate("repair_s", F.lit(0.0), lambda a, x: a + x)) / F.nullif(repairs, F.lit(0)), F.lit(0.0)).alias("mean_repair_s"),
    )


def ranking_recall(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """questions, share whose gold columns are all in the top k, and share whose first column is gold; those without gold don't count."""
    top = ranked.filter(F.col("rank") <= k).groupBy("question_id").agg(F.collect_set("column_name").alias("top"), F.max(F.when(F.col("rank") == 1, F.col("column_name"))).alias("first"))
    joined = gold.filter(F.size("gold") > 0).join(top, "question_id", "left")
    full = F.coalesce(F.size(F.array_except("gold", "top")) == 0, F.lit(False)).cast("int")
    hit = F.coalesce(F.array_contains("gold", F.col("first")), F.lit(False)).cast("int")
    return joined.agg(F.count("*").alias("questions"), F.coalesce(F.avg(full), F.lit(0.0)).alias("full_recall"), F.coalesce(F.avg(hit), F.lit(0.0)).alias("top1_hit"))


def run(system: Callable[[str], dict], questions: DataFrame, log: str | None = None) -> dict:
    """Ask a system every question (question, truth) and score it: accuracy() over all, `errors` with the wrong and failed ones.

    A test set is a list that people check, and each question is a call of a model, so it is asked one by one from the driver; the
    scores are the same expressions as for answers that lie in a table. The errors are also written to `log` as a JSON array.
    """
    spark, rows, said = questions.sparkSession, [], []
    for number, (question, truth) in enumerate(questions.select("question", "truth").orderBy("question").collect()):
        began = time.time()
        entry = {"id": number, "question": question, "truth": truth}
        try:
            found = system(question)
        except Exception as error:  # a system's failure is a wrong answer
            entry["error"] = f"{type(error).__name__}: {error}"
            found = {}
        took = time.time() - began
        result = [[None if c is None else str(c) for c in r] for r in found.get("execution_result") or []]
        rows.append((number, truth, result, float(found.get("cost_time") or took), float(found.get("first_inference_time") or 0.0), [float(x) for x in found.get("repair_times") or []]))
        said.append(entry | {"sql": found.get("final_sql")})
    table = spark.createDataFrame(rows, "id int, truth string, result array<array<string>>, total_s double, first_s double, repair_s array<double>")
    lines = F.transform("result", lambda r: F.array_join(F.transform(r, lambda c: cell_text(F.coalesce(c, F.lit("")))), "|"))
    table = table.withColumn("lines", F.sort_array(F.array_distinct(F.filter(lines, lambda x: F.replace(x, F.lit("|"), F.lit("")) != ""))))
    right = truth_items(F.coalesce("truth", F.lit(""))) == F.col("lines")
    scored = table.select("*", F.coalesce(right, F.lit(False)).alias("right"))
    wrong = {r["id"]: r["lines"] for r in scored.filter("not right").select("id", "lines").collect()}
    errors = [e | {"predicted": list(wrong[e["id"]])} for e in said if e["id"] in wrong]
    if log:
        with open(log, "w", encoding="utf-8") as out:
            json.dump(errors, out, ensure_ascii=False, indent=2)
    marked = scored.select(F.lit("1").alias("truth"), F.when(F.col("right"), F.lit("1")).otherwise("0").alias("predicted"), "total_s", "first_s", "repair_s")
    return accuracy(marked).first().asDict() | {"errors": errors}
