"""Self-consistency: fingerprints of results, vote counts, the winner and its representative."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lakeask.functions.text import cell_text


def fingerprints(results: DataFrame, by: list[str], cells: list[str]) -> DataFrame:
    """(by, fingerprint, n_rows): a digest of each result's distinct rows, whatever their order; rows of blank cells don't count."""
    cell = [cell_text(F.col(c).cast("string")) for c in cells]
    row = F.concat_ws("|", *cell)
    blank = F.concat(*cell) == ""
    rows = results.filter(~blank).select(*by, row.alias("row")).distinct()
    return rows.groupBy(*by).agg(F.md5(F.array_join(F.sort_array(F.collect_list("row")), "\n")).alias("fingerprint"), F.count("*").alias("n_rows"))


def priority(path: Column) -> Column:
    """thinking before ICL before direct."""
    low = F.lower(path)
    return F.when(low.contains("thinking"), 0).when(low.contains("icl"), 1).when(low.contains("direct"), 2).otherwise(3)


def votes(candidates: DataFrame, by: list[str]) -> DataFrame:
    """candidates that have a fingerprint, with `votes`: how many of the same `by` have it too. No join: fingerprints are made once."""
    return candidates.filter("fingerprint is not null").withColumn("votes", F.count("*").over(W.partitionBy(*by, "fingerprint")))


def majority(candidates: DataFrame, by: list[str]) -> DataFrame:
    """(by, agreed): do two candidates or more agree?"""
    return votes(candidates, by).groupBy(*by).agg((F.max("votes") >= 2).alias("agreed"))


def select_best(candidates: DataFrame, by: list[str], path: str = "path") -> DataFrame:
    """(by, path, fingerprint, votes, status) of the winner: the largest group's candidate of best priority. If two groups are
    equally large, status is `tie` and priority decides between their candidates."""
    best = F.max("votes").over(W.partitionBy(*by))
    leaders = votes(candidates, by).withColumn("best", best).filter("votes = best")
    groups = F.size(F.collect_set("fingerprint").over(W.partitionBy(*by)))
    order = W.partitionBy(*by).orderBy(priority(F.col(path)), path)
    ranked = leaders.withColumn("groups", groups).withColumn("place", F.row_number().over(order))
    return ranked.filter("place = 1").select(*by, path, "fingerprint", "votes", F.when(F.col("groups") > 1, "tie").otherwise("win").alias("status"))
