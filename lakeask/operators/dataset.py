"""Training and evaluation sets: splits, negatives, ranker and chat samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lakeask.functions.arrow import sequence_ratio
from lakeask.functions.text import placeholder_columns

# Shares of the split, numbers of negatives, boost and its words.
TRAIN, VALIDATE, HARD, EASY, BOOST = 0.8, 0.1, 3, 7, 0.2
DOMAIN_WORDS = ("金额", "价", "数量", "码", "日期", "名称")
GENERAL_WORDS = ("id", "time", "date", "name", "type", "status", "code", "amount", "num", "count")


def seeded_order(key: Column, seed: str = "42") -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(seed)))


def split_ordinal(rows: DataFrame, key: str, seed: str = "42", buckets: int = 1024) -> DataFrame:
    """rows with `split`: the first int(0.8 n) by seeded hash are train, up to int(0.9 n) val, the others test.

    The global rank is made of hash-prefix buckets: counts of a fixed number of buckets are summed on the driver, and each
    bucket ranks its own rows, so that no task sorts everything.
    """
    coded = rows.withColumn("_order", seeded_order(F.col(key), seed)).withColumn("_bucket", F.conv(F.substring("_order", 1, 4), 16, 10).cast("int"))
    shift = 65536 // buckets
    coded = coded.withColumn("_bucket", F.floor(F.col("_bucket") / shift).cast("int"))
    counts = dict(coded.groupBy("_bucket").count().collect())
    before, total = {}, 0
    for b in sorted(counts):
        before[b], total = total, total + counts[b]
    offsets = rows.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "_bucket int, _before long")
    rank = F.row_number().over(W.partitionBy("_bucket").orderBy("_order", key)) - 1
    ranked = coded.withColumn("_rank", rank).join(F.broadcast(offsets), "_bucket").withColumn("_rank", F.col("_rank") + F.col("_before"))
    name = F.when(F.col("_rank") < int(total * TRAIN), "train").when(F.col("_rank") < int(total * (TRAIN + VALIDATE)), "val").otherwise("test")
    return ranked.withColumn("split", name).drop("_order", "_bucket", "_rank", "_before")


def _shares_word(a: Column, b: Column, words: tuple[str, ...], same: bool) -> Column:
    has = lambda c: F.transform(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w))
    if same:
        return F.exists(F.zip_with(has(a), has(b), lambda x, y: x & y), lambda x: x)
    return F.exists(has(F.lower(a)), lambda x: x) & F.exists(has(F.lower(b)), lambda x: x)


def negatives(samples: DataFrame, columns: DataFrame, hard: int = HARD, easy: int = EASY, words: tuple[str, ...] = DOMAIN_WORDS, same: bool = True, seed: str = "42") -> DataFrame:
    """(sample_id, column_name, kind) for samples (sample_id, targets): the `hard` columns most like a target, and `easy` others
    by seeded hash. `columns` is a schema's column list, bounded by its width; similarities are computed once per distinct
    pair of names."""
    names = columns.select("column_name").distinct()
    targets = samples.select(F.explode("targets").alias("target")).distinct()
    pairs = targets.join(F.broadcast(names), F.col("target") != F.col("column_name"))
    pairs = pairs.withColumn("sim", sequence_ratio()("column_name", "target") + F.when(_shares_word(F.col("column_name"), F.col("target"), words, same), BOOST).otherwise(0.0))
    each = samples.select("sample_id", "targets", F.explode("targets").alias("target")).join(pairs, "target")
    best = each.filter(~F.array_contains("targets", F.col("column_name"))).groupBy("sample_id", "column_name").agg(F.max("sim").alias("sim"))
    hard_rank = F.row_number().over(W.partitionBy("sample_id").orderBy(F.desc("sim"), "column_name"))
    ranked = best.withColumn("kind", F.when(hard_rank <= hard, "hard").otherwise("easy"))
    easy_rank = F.row_number().over(W.partitionBy("sample_id", "kind").orderBy(F.md5(F.concat_ws("#", F.col("sample_id").cast("string"), "column_name", F.lit(seed)))))
    return ranked.withColumn("place", easy_rank).filter((F.col("kind") == "hard") | (F.col("place") <= easy)).select("sample_id", "column_name", "kind")


def ranker_samples(samples: DataFrame, columns: DataFrame, **options) -> DataFrame:
    """(question, column, label): a row per target with label 1, and per negative with label 0."""
    positive = samples.select("question", F.explode("targets").alias("column"), F.lit(1).alias("label"))
    negative = samples.join(negatives(samples, columns, **options), "sample_id").select("question", F.col("column_name").alias("column"), F.lit(0).alias("label"))
    return positive.unionByName(negative)


def gold_columns(templates: DataFrame, question: str, answer: str) -> DataFrame:
    """templates with `targets`: the columns that question and answer template name."""
    return templates.withColumn("targets", F.array_sort(F.array_union(placeholder_columns(F.col(question)), placeholder_columns(F.col(answer)))))


def chat_samples(turns: DataFrame, by: str, order: str) -> DataFrame:
    """(by, messages): the turns of each conversation in order, as role and content."""
    message = F.struct(order, F.struct("role", F.col("text").alias("content")).alias("m"))
    return turns.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(message)), lambda x: x["m"]).alias("messages"))


def schema_samples(samples: DataFrame, columns: DataFrame, metadata: DataFrame, instruction: str, hard: int = 7, easy: int = 3) -> DataFrame:
    """(sample_id, messages): system instruction, schema of targets and negatives with the question, and the SQL."""
    chosen = samples.select("sample_id", F.explode("targets").alias("column_name")).union(negatives(samples, columns, hard, easy, GENERAL_WORDS, same=False).select("sample_id", "column_name")).distinct()
    line = F.format_string("(%s, %s)", F.col("column_name"), F.coalesce("column_description", F.lit("")))
    ordered = F.sort_array(F.collect_list(F.struct(seeded_order(F.concat_ws("#", "sample_id", "column_name")).alias("o"), line.alias("line"))))
    schema = chosen.join(F.broadcast(metadata), "column_name", "left").groupBy("sample_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("schema"))
    said = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return samples.join(schema, "sample_id").select("sample_id", F.array(said("system", F.lit(instruction)), said("user", F.concat_ws("\n", "schema", "question")), said("assistant", F.col("sql"))).alias("messages"))
