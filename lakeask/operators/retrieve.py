"""Top-k retrieval by cosine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from lakeask.functions.text import cosine


#: Queries that meet the items at a time.
BLOCK = 4096


def top_k(queries: DataFrame, items: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, item_id, score, rank) of each query's k nearest items; ties by item id.

    Queries meet all items block by block through a broadcast of at most about BLOCK of them, and each partition keeps only its
    own best k of a query before anything is shuffled.
    """
    blocks = max(1, -(-queries.count() // BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [_top_of_block(queries.filter(block == b) if blocks > 1 else queries, items, k) for b in range(blocks)])


def _top_of_block(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    scored = items.join(F.broadcast(queries), F.lit(True)).select("query_id", "item_id", F.round(cosine(F.col("query_vector"), F.col("item_vector")).cast("decimal(20,10)"), 4).cast("double").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "item_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)
