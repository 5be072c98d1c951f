"""Column profiles: all columns in one pass over (column, value) rows."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from lakeask.functions.text import format_class, is_numeric, number, strip

# Limits of a profile.
CATEGORICAL, NUMERIC_SHARE, TOP, FORMAT_SAMPLE, FORMAT_SHARE, SHOW_NULLS = 80, 0.8, 10, 50, 0.5, 0.3


def as_text(df: DataFrame, name: str) -> Column:
    """A column as text that other engines write alike: doubles through a decimal, times to the second."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, (T.DoubleType, T.FloatType)):  # what a decimal can't hold, as infinities, stays as it is written
        fixed = c.try_cast("decimal(38,4)").cast("string")
        return F.coalesce(fixed, c.cast("string"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return c.cast("string")


def long_form(df: DataFrame, columns: list[str] | None = None, key: str | None = None) -> DataFrame:
    """(column, value[, key]) with values stripped and blanks as null: each row unpivots to one row per column."""
    names = columns or [f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.nullif(strip(as_text(df, n)), F.lit("")).alias("value")) for n in names])).alias("cell")
    return df.select(*([F.col(key).alias("key")] if key else []), cells).select("cell.column", "cell.value", *(["key"] if key else []))


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, count): the one shuffle that all the figures below come from; nulls and blanks count as null."""
    return long_form(df, columns).groupBy("column", "value").count()


def profile(counts: DataFrame) -> DataFrame:
    """One row per column: totals, nulls, distinct values, type, range, categorical flag."""
    base = F.col("value").isNotNull()
    n = F.col("count")
    out = counts.groupBy("column").agg(
        F.sum("count").alias("total"),
        F.coalesce(F.sum(F.when(~base, n)), F.lit(0)).alias("null_count"),
        F.count("value").alias("distinct_count"),
        F.coalesce(F.sum(F.when(base & is_numeric(F.col("value")), n)), F.lit(0)).alias("numbers"),
        F.min(number(F.col("value"))).alias("low"),
        F.max(number(F.col("value"))).alias("high"),
    )
    share = F.col("numbers") / F.greatest(F.col("total") - F.col("null_count"), F.lit(1))
    numeric = share > NUMERIC_SHARE
    two = lambda c: F.when(numeric, F.coalesce(F.round(F.col(c).try_cast("decimal(38,6)"), 2).cast("double"), F.col(c)))
    return out.select(
        "column", "total", "null_count", F.when(F.col("total") > 0, F.col("null_count") / F.col("total")).otherwise(0.0).alias("null_ratio"), "distinct_count",
        F.when(numeric, "NUMERIC").otherwise("TEXT").alias("data_type"), two("low").alias("min_value"), two("high").alias("max_value"), (F.col("distinct_count") <= CATEGORICAL).alias("is_categorical"),
    )


def top_values(counts: DataFrame, most: int = TOP) -> DataFrame:
    """(column, value, count, rank) of the commonest values; ties by value. The limit is pushed below the shuffle."""
    rank = F.row_number().over(W.partitionBy("column").orderBy(F.desc("count"), "value"))
    return counts.filter("value is not null").withColumn("rank", rank).filter(F.col("rank") <= most)


def formats(df: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """(column, format_pattern): the commonest format of the first values by key, if over half of them have it."""
    rank = F.row_number().over(W.partitionBy("column").orderBy("key", "value"))
    first = long_form(df, columns, key).filter("value is not null").withColumn("rank", rank).filter(F.col("rank") <= FORMAT_SAMPLE)
    classed = first.groupBy("column", format_class(F.col("value")).alias("format")).count()
    size = F.sum("count").over(W.partitionBy("column"))
    return classed.withColumn("size", size).filter(F.col("format").isNotNull() & (F.col("count") / F.col("size") > FORMAT_SHARE)).select("column", F.col("format").alias("format_pattern"))


def categorical_values(counts: DataFrame) -> DataFrame:
    """(column, value) of every legal value of the categorical columns."""
    wanted = profile(counts).filter("is_categorical").select("column")
    return counts.filter("value is not null").join(F.broadcast(wanted), "column").select("column", "value")


def summaries(counts: DataFrame, formats_of: DataFrame | None = None) -> DataFrame:
    """(column, inline): type; null share if large; samples; range of numbers; format."""
    tops = top_values(counts, 6).groupBy("column").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda x: F.substring(x["value"], 1, 25)).alias("samples"))
    rows = profile(counts).join(tops, "column", "left")
    rows = rows.join(formats_of, "column", "left") if formats_of is not None else rows.withColumn("format_pattern", F.lit(None).cast("string"))
    shown = lambda c: F.coalesce(F.col(c).try_cast("decimal(38,2)").cast("string"), F.col(c).cast("string"))
    inline = F.concat_ws(
        "; ", "data_type", F.when(F.col("null_ratio") > SHOW_NULLS, F.concat(F.lit("nulls "), F.round(F.col("null_ratio") * 100).cast("int").cast("string"), F.lit("%"))), F.array_join("samples", "/"),
        F.when(F.col("data_type") == "NUMERIC", F.concat(shown("min_value"), F.lit(".."), shown("max_value"))), "format_pattern",
    )
    return rows.select("column", inline.alias("inline"))


def descriptions(counts: DataFrame, formats_of: DataFrame | None = None) -> DataFrame:
    """(column, summary): name, type, null share if large, distinct values, the commonest of a categorical column, range, format."""
    tops = top_values(counts, 5).groupBy("column").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("samples"))
    rows = profile(counts).join(tops, "column", "left")
    rows = rows.join(formats_of, "column", "left") if formats_of is not None else rows.withColumn("format_pattern", F.lit(None).cast("string"))
    shown = lambda c: F.coalesce(F.col(c).try_cast("decimal(38,2)").cast("string"), F.col(c).cast("string"))
    part = lambda name, c: F.concat(F.lit(f"{name}="), c)
    summary = F.concat_ws(
        " | ", "column", part("type", F.col("data_type")), F.when(F.col("null_ratio") > SHOW_NULLS, F.concat(F.lit("nulls="), F.round(F.col("null_ratio") * 100).cast("int").cast("string"), F.lit("%"))),
        part("distinct", F.col("distinct_count").cast("string")), F.when(F.col("is_categorical") & F.col("samples").isNotNull(), F.concat(F.lit("common=["), F.array_join("samples", ", "), F.lit("]"))),
        part("format", F.col("format_pattern")), F.when(F.col("data_type") == "NUMERIC", F.concat(F.lit("range=["), shown("min_value"), F.lit(", "), shown("max_value"), F.lit("]"))),
    )
    return rows.select("column", summary.alias("summary"))


def preview(df: DataFrame, key: str | None = None, shown: int = 5) -> str:
    """What a table holds, as text: a line a column in the table's order, then its categorical columns with their first values."""
    counts = value_counts(df).cache()
    try:
        lines = dict(descriptions(counts, formats(df, key) if key else None).collect())
        legal = categorical_values(counts).groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("values")).collect()
    finally:
        counts.unpersist()
    named = {r["column"]: r["values"] for r in legal}
    found = [f"  {c}: {named[c][:shown]}{'...' if len(named[c]) > shown else ''}" for c in df.columns if c in named]
    return "\n".join([*(lines[c] for c in df.columns if c in lines), f"{len(found)} categorical columns:", *found])


def main(path: str) -> None:
    """python -m lakeask.operators.profile PATH: the preview of a CSV, JSON or Parquet file."""
    from lakeask import session
    from lakeask.sources import tables

    spark = session.build()
    print(preview(tables.ingest(tables.source(spark, path=path))))


if __name__ == "__main__":
    main(*sys.argv[1:])
