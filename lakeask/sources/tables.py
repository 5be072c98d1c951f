"""Sources and sinks: CSV and text schemas in, tables, JSON and CSV out, an index cache with invalidation."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lakeask.functions.text import NULL_TOKENS, STRIPPED, is_numeric, normalise, not_blank, number, strip

SCHEMA_LINE = r"^\s*\(([^:]+):\s*([^,]+),\s*(.*?),?\s*(?:Examples:\s*\[(.*)\])?\s*\)\s*,?\s*$"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, headers trimmed; quotes doubled inside quotes, values over several lines."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    return df.toDF(*[c.strip() for c in df.columns])


def ingest(df: DataFrame, numeric: list[str] = (), null_tokens: tuple[str, ...] = NULL_TOKENS) -> DataFrame:
    """Normalise text columns once, so that index, profile and queries all see the same values; cast the numeric ones.

    Texts that are a null token become null; a numeric column's unreadable values become null.
    """
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if not isinstance(f.dataType, T.StringType):
            out.append(c)
            continue
        clean = normalise(c)
        clean = F.when(~F.lower(clean).isin(*null_tokens), clean)
        out.append(number(F.regexp_replace(clean, ",", "")).alias(f.name) if f.name in numeric else clean.alias(f.name, metadata={**f.metadata, STRIPPED: True}))
    return df.select(*out)


def infer_numeric(df: DataFrame, share: float = 1.0) -> list[str]:
    """Text columns whose non-blank cells, thousands commas aside, are numbers in at least that share: one pass over the rows.
    Columns without a cell are none."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not names:
        return []
    clean = {n: normalise(F.col(f"`{n}`")) for n in names}
    filled = {n: not_blank(clean[n]) & ~F.lower(clean[n]).isin(*NULL_TOKENS) for n in names}
    found = df.agg(*[f for k, n in enumerate(names) for f in (F.count_if(filled[n]).alias(f"n{k}"), F.count_if(filled[n] & is_numeric(F.regexp_replace(clean[n], ",", ""))).alias(f"m{k}"))]).first()
    return [n for k, n in enumerate(names) if found[f"n{k}"] and found[f"m{k}"] >= share * found[f"n{k}"]]


def drop_blank_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows with a cell, of those columns or of all, that is neither null nor blank."""
    cells = [F.col(f"`{n}`").cast("string") for n in columns or df.columns]
    return df.filter(reduce(lambda a, b: a | b, [not_blank(c) for c in cells]))


def matched(df: DataFrame, status: str = "status") -> DataFrame:
    """Rows whose check ended in MATCH."""
    return df.filter(F.col(f"`{status}`") == "MATCH")


def distinct_sample(df: DataFrame, column: str, most: int = 20) -> DataFrame:
    """(value): the first distinct values of a column that aren't blank, in order."""
    text = F.col(f"`{column}`").cast("string")
    return df.filter(not_blank(text)).select(text.alias("value")).distinct().orderBy("value").limit(most)


def columns_of(spark: SparkSession, path: str) -> list[str]:
    """Header only: no job over the rows."""
    return [c.strip() for c in spark.read.csv(path, header=True, inferSchema=False).columns]


def first_rows(df: DataFrame, count: int, key: str) -> DataFrame:
    return df.orderBy(key).limit(count)


def source(spark: SparkSession, df: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """The given frame, or the file at path by its ending; an error without either."""
    if df is not None:
        return df
    if not path:
        raise ValueError("neither a DataFrame nor a path")
    ending = path.rsplit(".", 1)[-1].lower()
    return {"csv": lambda: read_csv(spark, path), "parquet": lambda: spark.read.parquet(path), "json": lambda: read_json_array(spark, path), "jsonl": lambda: spark.read.json(path)}.get(ending, lambda: spark.read.parquet(path))()


def read_schema_text(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, column_name, data_type, column_description, examples) of lines `(name: TYPE, description, Examples: [a, b])`."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("ordinal", "line"))
    return parse_schema_lines(lines)


def parse_schema_lines(lines: DataFrame) -> DataFrame:
    part = lambda k: strip(F.regexp_extract("line", SCHEMA_LINE, k))
    examples = F.filter(F.transform(F.split(part(4), ","), strip), lambda x: x != "")
    return lines.filter(F.col("line").rlike(SCHEMA_LINE)).select("ordinal", part(1).alias("column_name"), part(2).alias("data_type"), part(3).alias("column_description"), examples.alias("examples"))


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, **splits: str) -> dict[str, DataFrame]:
    return {name: spark.read.json(path) for name, path in splits.items()}


def read_examples(spark: SparkSession, path: str, question: str = "问题模版", sql: str = "SQL模版") -> DataFrame:
    """Question and SQL templates; an absent file gives an empty table, which switches the examples off."""
    try:
        return read_csv(spark, path).select(F.col(question).alias("question"), F.col(sql).alias("sql")).filter("question is not null and sql is not null")
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error) or "UNRESOLVED_COLUMN" in str(error):
            return spark.createDataFrame([], "question string, sql string")
        raise


def register(df: DataFrame, name: str, types: dict[str, str] | None = None) -> DataFrame:
    """A temporary view, with casts that give null for unreadable values."""
    out = df.withColumns({c: F.col(f"`{c}`").try_cast(t) for c, t in (types or {}).items()}) if types else df
    out.createOrReplaceTempView(name)
    return out


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, append: bool = False) -> None:
    """CSV in a fixed column order; columns that df lacks are empty."""
    names = columns or df.columns
    rows = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in names])
    rows.write.mode("append" if append else "overwrite").csv(path, header=True, escape='"')


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """A pretty JSON array: rows come to the driver one partition at a time and go to a single file."""
    with open(path, "w", encoding="utf-8") as out:
        out.write("[")
        for k, row in enumerate(df.toJSON().toLocalIterator()):
            out.write((",\n" if k else "\n") + json.dumps(json.loads(row), ensure_ascii=False, indent=2))
        out.write("\n]\n")


def save_index(index: DataFrame, path: str, **stamp: str) -> None:
    """The index as Parquet and what it was made from (version, file time, model) beside it."""
    index.write.mode("overwrite").parquet(f"{path}/rows")
    index.sparkSession.createDataFrame([(k, str(v)) for k, v in stamp.items()], "name string, value string").write.mode("overwrite").parquet(f"{path}/stamp")


def load_index(spark: SparkSession, path: str, **stamp: str) -> DataFrame | None:
    """The saved index, or None if it is absent or made from something else."""
    try:
        saved = {r["name"]: r["value"] for r in spark.read.parquet(f"{path}/stamp").limit(len(stamp) + 1).collect()}
        return spark.read.parquet(f"{path}/rows") if saved == {k: str(v) for k, v in stamp.items()} else None
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def done_counts(output: DataFrame, template: str) -> DataFrame:
    """How many rows of each template a former run wrote."""
    return output.groupBy(template).count()


def still_needed(templates: DataFrame, output: DataFrame, template: str, target: int) -> DataFrame:
    """Templates with fewer than `target` rows so far, and how many they lack."""
    joined = templates.join(done_counts(output, template), template, "left")
    have = F.coalesce("count", F.lit(0))
    return joined.filter(have < target).select(*templates.columns, (F.lit(target) - have).alias("needed"))
