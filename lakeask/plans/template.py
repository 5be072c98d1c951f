"""Answer templates: parser, tree, and compilers to a DataFrame, Spark SQL and DuckDB SQL."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from lakeask.functions.text import SPACE, STRIPPED, not_blank, plain_strip, strip

OPERATORS = (">=", "<=", "!=", "==", ">", "<")


class TemplateError(ValueError):
    """A template that can't be read, or a column that the data lack."""


@dataclass(frozen=True)
class Condition:
    column: str
    operator: str
    value: float


@dataclass(frozen=True)
class Template:
    """kind: count, sum, avg, count1, list or project. fields: question slots and how often each occurs."""

    kind: str
    fields: tuple[tuple[str, int], ...] = ()
    column: str | None = None
    condition: Condition | None = None
    groups: tuple[str, ...] = ()
    descending: bool = True
    limit: int | None = None

    @property
    def filled(self) -> tuple[str, ...]:
        """Columns whose blank cells don't count."""
        return {"count1": (self.column,), "project": self.groups, "list": self.groups}.get(self.kind, ())

    @property
    def columns(self) -> tuple[str, ...]:
        named = (self.column,) if self.column else ()
        return (*named, *self.groups, *((self.condition.column,) if self.condition else ()))


def _names(text: str, split: str) -> tuple[str, ...]:
    names = tuple(x.strip() for x in re.split(split, text))
    if not all(names):
        raise TemplateError(f"an empty name in {{{text}}}")
    return names


def parse_condition(text: str) -> Condition:
    for op in OPERATORS:
        column, found, value = text.partition(op)
        if found:
            try:
                return Condition(column.strip(), op, float(value))
            except ValueError as bad:
                raise TemplateError(f"no number in {text!r}") from bad
    raise TemplateError(f"no comparison in {text!r}")


def parse(question: str, answer: str) -> Template:
    fields = tuple(Counter(x.strip() for x in re.findall(r"\{([^}]+)\}", question)).items())
    text = answer.strip()
    if re.fullmatch(r"(?i)count\{\s*\}", text):
        return Template("count", fields)
    if m := re.fullmatch(r"(?i)list(down|up)\s*\{([^}]+)\}\s*\{([^}]+)\}\s*\*\s*(\d+|\*)", text):
        measure = m[2].strip()
        return Template("list", fields, None if measure.lower() == "count" else measure, None, _names(m[3], "[,，]"), m[1].lower() == "down", None if m[4] == "*" else int(m[4]))
    if m := re.fullmatch(r"(?i)(sum|avg|count1)\{([^}]+)\}", text):
        column, bar, condition = m[2].partition("|")
        if bar and m[1].lower() != "count1":
            raise TemplateError(f"{m[1]} takes no condition")
        return Template(m[1].lower(), fields, column.strip(), parse_condition(condition) if bar else None)
    if text == "*":
        return Template("project", fields)  # no column named: whole rows
    if re.fullmatch(r"(\{[^}]+\}\s*)+", text):
        return Template("project", fields, None, None, tuple(n for part in re.findall(r"\{([^}]+)\}", text) for n in _names(part, "，")))
    raise TemplateError(f"unreadable answer template: {answer!r}")


def _text(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if isinstance(df.schema[name].dataType, T.StringType) else F.col(f"`{name}`").cast("string")


def _equals(df: DataFrame, name: str, values: list[str]) -> Column:
    """Is a column's stripped text one of the values? Columns that `ingest` has marked as stripped, and other types, are compared
    as they are, so that the test reaches the scan; elsewhere only texts longer than the shortest value are stripped."""
    c, wanted = _text(df, name), [plain_strip(v) for v in values]
    same = lambda x: x == wanted[0] if len(wanted) == 1 else x.isin(*wanted)
    if STRIPPED in df.schema[name].metadata or not isinstance(df.schema[name].dataType, T.StringType):
        return same(c)
    return same(c) | ((F.length(c) > min(map(len, wanted))) & same(strip(c)))


def _check(df: DataFrame, template: Template, slots: dict[str, list[str]]) -> None:
    missing = [c for c in (*(f for f, _ in template.fields), *template.columns) if c not in df.columns]
    if missing:
        raise TemplateError(f"no such column: {', '.join(missing)}")
    unfilled = [f for f, _ in template.fields if not slots.get(f)]
    if unfilled:
        raise TemplateError(f"no value for: {', '.join(unfilled)}")


def _compare(c: Column, op: str, value: float) -> Column:
    return {">": c > value, "<": c < value, ">=": c >= value, "<=": c <= value, "==": c == value, "!=": c != value}[op]


def filtered(df: DataFrame, template: Template, slots: dict[str, list[str]]) -> DataFrame:
    """Rows that meet the slots (one value: equality; more: membership) and the template's own conditions."""
    _check(df, template, slots)
    tests = [_equals(df, f, slots[f] if n > 1 else slots[f][:1]) for f, n in template.fields]
    if template.condition:
        tests.append(_compare(F.col(f"`{template.condition.column}`").try_cast("double"), template.condition.operator, template.condition.value))
    tests += [not_blank(_text(df, c)) for c in template.filled]
    if template.kind == "list" and template.column:
        tests.append(_number(F.col(f"`{template.column}`")).isNotNull())
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def _number(c: Column) -> Column:
    """A cell as an exact number: sums don't depend on the order of rows. Up to 10^32, to six places."""
    return c.try_cast("double").try_cast("decimal(38,6)")


def to_dataframe(df: DataFrame, template: Template, slots: dict[str, list[str]] | None = None) -> DataFrame:
    """Results: `result` for scalars; group columns and `_val` for lists; the named columns, distinct, for projections."""
    rows = filtered(df, template, slots or {})
    column = F.col(f"`{template.column}`") if template.column else None
    groups = [F.col(f"`{g}`") for g in template.groups]
    if template.kind == "count":
        return rows.agg(F.count("*").alias("result"))
    if template.kind == "sum":
        return rows.agg(F.round(F.sum(_number(column)), 2).cast("double").alias("result"))
    if template.kind == "avg":
        return rows.agg(F.round(F.sum(_number(column)).cast("double") / F.nullif(F.count(_number(column)), F.lit(0)), 2).alias("result"))
    if template.kind == "count1":
        return rows.agg(F.count_distinct(strip(_text(df, template.column))).alias("result"))
    if template.kind == "project":
        return rows.select(*groups or ["*"]).distinct()
    value = F.count("*") if column is None else F.round(F.sum(_number(column)), 2).cast("double")
    ranked = rows.groupBy(*groups).agg(value.alias("_val"))
    order = F.col("_val").desc_nulls_last() if template.descending else F.col("_val").asc_nulls_first()
    return ranked.orderBy(order, *groups).limit(template.limit) if template.limit is not None else ranked


def to_sql(template: Template, table: str, slots: dict[str, list[str]] | None = None, dialect: str = "spark", number_columns: frozenset[str] = frozenset()) -> str:
    """The same result as SQL text. Columns in number_columns are cast to text where the DataFrame casts them."""
    slots = slots or {}
    quote = (lambda n: "`" + n.replace("`", "``") + "`") if dialect == "spark" else (lambda n: '"' + n.replace('"', '""') + '"')
    text = (lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'") if dialect == "spark" else (lambda v: "'" + v.replace("'", "''") + "'")
    kind = "string" if dialect == "spark" else "varchar"
    as_text = lambda n: f"CAST({quote(n)} AS {kind})" if n in number_columns else quote(n)
    trim = (lambda e: f"regexp_replace({e}, {text(f'^{SPACE}+|{SPACE}+$')}, '')") if dialect == "spark" else (lambda e: f"regexp_replace({e}, {text(f'^{SPACE}+|{SPACE}+$')}, '', 'g')")
    money = lambda n: f"TRY_CAST(TRY_CAST({quote(n)} AS double) AS decimal(38,6))"
    cell = lambda n: as_text(n) if n in number_columns else trim(as_text(n))
    value = lambda v: text(plain_strip(v))
    tests = [f"{cell(f)} IN ({', '.join(map(value, slots[f]))})" if n > 1 else f"{cell(f)} = {value(slots[f][0])}" for f, n in template.fields]
    if c := template.condition:
        tests.append(f"TRY_CAST({quote(c.column)} AS double) {'=' if c.operator == '==' else c.operator} {c.value!r}")
    for n in template.filled:
        tests.append(f"{quote(n)} IS NOT NULL AND {trim(as_text(n))} <> ''")
    if template.kind == "list" and template.column:
        tests.append(f"{money(template.column)} IS NOT NULL")
    where = f" WHERE {' AND '.join(tests)}" if tests else ""
    groups = ", ".join(map(quote, template.groups))
    if template.kind == "project":
        return f"SELECT DISTINCT {groups or '*'} FROM {table}{where}"
    total = f"CAST(ROUND(SUM({money(template.column)}), 2) AS double)" if template.column else "COUNT(*)"
    if template.kind == "list":
        order = f" ORDER BY {quote('_val')} {'DESC NULLS LAST' if template.descending else 'ASC NULLS FIRST'}, {groups} LIMIT {template.limit}" if template.limit is not None else ""
        return f"SELECT {groups}, {total} AS {quote('_val')} FROM {table}{where} GROUP BY {groups}{order}"
    result = {"count": "COUNT(*)", "sum": total, "avg": f"ROUND(CAST(SUM({money(template.column or '')}) AS double) / NULLIF(COUNT({money(template.column or '')}), 0), 2)", "count1": f"COUNT(DISTINCT {trim(as_text(template.column or ''))})"}[template.kind]
    return f"SELECT {result} AS result FROM {table}{where}"


def first_values(df: DataFrame, column: str, count: int, ordinal: str) -> DataFrame:
    """The first `count` distinct values by first appearance, with their rank; a repeated slot takes these."""
    firsts = df.filter(not_blank(_text(df, column))).groupBy(_text(df, column).alias("value")).agg(F.min(ordinal).alias("first"))
    top = firsts.orderBy("first", "value").limit(count)
    return top.withColumn("rank", F.row_number().over(W.orderBy("first", "value")))


def fill(df: DataFrame, template: Template, key: str, samples: int, seed: str = "42") -> DataFrame:
    """Sample rows (by seeded hash of the key) whose slot fields are all filled: the key and one text column per field."""
    fields = [f for f, _ in template.fields]
    rows = df.filter(reduce(lambda a, b: a & b, [not_blank(_text(df, f)) for f in fields], F.lit(True)))
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))
    return rows.select(F.col(key), *[_text(df, f).alias(f) for f in fields]).orderBy(order, key).limit(samples)


@contextmanager
def private_view(df: DataFrame) -> Iterator[str]:
    """The name of a view of df that no other has, dropped at the end."""
    name = f"lakeask_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    try:
        yield name
    finally:
        df.sparkSession.catalog.dropTempView(name)


def close(a: float | None, b: float | None) -> bool:
    return a == b or (None not in (a, b) and abs(a - b) <= 1e-5 * max(abs(a), abs(b)))


def same_text(a: str | None, b: str | None) -> str:
    """verdict() for two answers in text."""
    try:
        same = close(*(float(x) if x else None for x in (a, b)))
    except ValueError:
        same = a == b
    return "MATCH" if same else f"MISMATCH ({a} and {b})"


def verdict(left: DataFrame, right: DataFrame) -> str:
    """MATCH if two results are equal: one number within a relative 1e-5, or the same rows; else what differs."""
    if left.columns == ["result"] == right.columns:
        a, b = left.first()[0], right.first()[0]
        return "MATCH" if close(a, b) else f"MISMATCH ({a} and {b})"
    only_left, only_right = left.exceptAll(right).count(), right.exceptAll(left).count()
    return "MATCH" if not only_left and not only_right else f"Set Mismatch: {only_left} rows only on the left, {only_right} only on the right"


def dual_check(df: DataFrame, template: Template, slots: dict[str, list[str]] | None = None) -> str:
    """Evaluate a template as a DataFrame and as SQL text, and compare; errors come back as values."""
    try:
        direct = to_dataframe(df, template, slots)
        numbers = frozenset(f.name for f in df.schema if not isinstance(f.dataType, T.StringType))
        with private_view(df) as view:
            return verdict(direct, df.sparkSession.sql(to_sql(template, view, slots, "spark", numbers)))
    except Exception as error:  # a template is data: whatever it breaks is its verdict
        return f"ERROR: {type(error).__name__}: {error}"
