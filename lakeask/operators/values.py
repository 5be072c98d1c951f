"""Value index: which columns hold a value, exactly or nearly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from lakeask.functions.arrow import sequence_ratio
from lakeask.functions.text import JACCARD, characters, coverage, fuzzy_verified, jaccard, match_form, strip
from lakeask.operators.profile import long_form


def column_values(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Distinct (column, value) of the named columns, as table.column; values stripped, blanks left out."""
    parts = [long_form(df, columns).filter("value is not null").distinct().select(F.concat(F.lit(f"{t}."), "column").alias("column"), "value") for t, (df, columns) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def exact_index(values: DataFrame) -> DataFrame:
    """(value, columns): every value with the sorted names of the columns that hold it."""
    return values.groupBy("value").agg(F.sort_array(F.collect_set("column")).alias("columns"))


def lookup(keywords: DataFrame, index: DataFrame) -> DataFrame:
    """Keywords found exactly (stripped), with their columns."""
    return keywords.withColumn("value", strip(F.col("keyword"))).join(index, "value").select("keyword", "columns")


def misses(keywords: DataFrame, index: DataFrame) -> DataFrame:
    """Keywords not found exactly whose match form has two characters or more."""
    return keywords.withColumn("value", strip(F.col("keyword"))).filter(F.length(match_form(F.col("keyword"))) >= 2).join(index, "value", "left_anti").select("keyword")


def _forms(df: DataFrame, text: str) -> DataFrame:
    """df with the text's match form, its distinct characters in order, and their number."""
    return df.withColumn("norm", match_form(F.col(text))).withColumn("chars", F.sort_array(characters(F.col("norm")))).filter(F.size("chars") > 0)


def _prefixes(df: DataFrame, order: dict[str, int], threshold: float) -> DataFrame:
    """A row for each character of the prefix, in `order`, that two sets of Jaccard >= threshold must share one of."""
    n = F.size("chars")
    place = F.create_map(*[F.lit(x) for item in order.items() for x in item]) if order else F.lit(None).cast("map<string,int>")
    rank = lambda x: F.coalesce(F.try_element_at(place, x), F.lit(-1))
    ranked = F.transform(F.sort_array(F.transform("chars", lambda x: F.struct(rank(x).alias("r"), x.alias("x")))), lambda s: s["x"])
    keep = (n - F.ceil(n * threshold - 1e-9) + 1).cast("int")
    return df.withColumn("part", F.explode(F.slice(ranked, F.lit(1), keep)))


def near(keywords: DataFrame, values: DataFrame, threshold: float = JACCARD) -> DataFrame:
    """(keyword, column, value, jaccard) of all pairs at the threshold or over it, by an equi-join on prefix characters: no cross
    join, no candidate lost; sizes are compared before the sets.

    Prefixes take the characters that are rarest among the values, a table of at most as many entries as there are characters,
    cut to the commonest thousand, so that the join's keys are the rare ones; each distinct form of a value is joined once.
    """
    right = _forms(values.filter(F.length("value") >= 2), "value")
    forms = right.select("norm", "chars").distinct()
    common = forms.select(F.explode("chars").alias("x")).groupBy("x").count().orderBy(F.desc("count"), "x").limit(1000).collect()
    order = {r["x"]: k for k, r in enumerate(reversed(common))}
    left = _forms(keywords, "keyword").select("keyword", F.col("norm").alias("knorm"), F.col("chars").alias("kchars"), "chars")
    left = _prefixes(left, order, threshold).drop("chars")
    size = (F.size("kchars") >= threshold * F.size("chars") - 1e-9) & (F.size("chars") >= threshold * F.size("kchars") - 1e-9)
    pairs = left.join(_prefixes(forms, order, threshold), "part").filter(size).withColumn("jaccard", jaccard(F.col("kchars"), F.col("chars"))).filter(F.col("jaccard") >= threshold)
    pairs = pairs.drop("part").dropDuplicates(["keyword", "norm"])
    return pairs.join(right.select("column", "value", "norm"), "norm").select("keyword", "column", "value", "jaccard", "knorm", "norm", "kchars", "chars")


def verified(pairs: DataFrame, most: int = 2) -> DataFrame:
    """Pairs that pass the second check, the best `most` values of each keyword and column (Jaccard, then value)."""
    scored = pairs.withColumn("seq", sequence_ratio()(F.col("knorm"), F.col("norm")))
    kept = scored.filter(fuzzy_verified(F.col("knorm"), F.col("norm"), F.col("jaccard"), F.col("seq"), coverage(F.col("kchars"), F.col("chars"))))
    rank = F.row_number().over(W.partitionBy("keyword", "column").orderBy(F.desc("jaccard"), "value"))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= most).select("keyword", "column", "value", "jaccard", "rank")


def literals_present(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """The (column, value) pairs that occur: a semi join for many literals at once."""
    return pairs.join(values, ["column", "value"], "left_semi")
