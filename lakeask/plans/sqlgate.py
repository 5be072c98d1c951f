"""Read-only gate for candidate SQL, its execution in a session of its own, and literals of its filters."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache

from py4j.java_gateway import is_instance_of
from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lakeask.functions.text import strip
from lakeask.plans import dialect
from lakeask.plans.dialect import rewrite as rewrite_dialect
from lakeask.session import dialect_session

# Plan nodes of queries, groups of built-in functions that see nothing but their arguments, and expressions that name
# what is to be called or read only when they run, or the user.
QUERY_NODES = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Deduplicate Union Except Intersect Join UnresolvedHaving SubqueryAlias "
    "UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedWith WithWindowDefinition Window OneRowRelation LocalRelation UnresolvedInlineTable "
    "Pivot Unpivot Generate LateralJoin Expand Tail".split()
)
FUNCTION_GROUPS = frozenset(
    "agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs datetime_funcs generator_funcs hash_funcs json_funcs "
    "lambda_funcs map_funcs math_funcs predicate_funcs string_funcs struct_funcs window_funcs".split()
)
BARRED_EXPRESSIONS = frozenset("ExpressionWithUnresolvedIdentifier CurrentUser CurrentDatabase CurrentCatalog".split())
BARRED_ATTRIBUTES = frozenset("current_user session_user user current_catalog current_database current_schema".split())


#: What a plan can fail with when it runs; some errors of the JVM come as they are.
FAILURES = (PySparkException, Py4JJavaError)


@dataclass
class Whole:
    """Figures of all rows of a result: its distinct rows, those of them with a cell that isn't blank, and a digest of the distinct
    rows' plain cells, whatever their order."""

    data: DataFrame
    rows: int
    full_rows: int
    fingerprint: tuple


@dataclass
class Outcome:
    """A result or an error as a value: NO_SUCH_COLUMN, SQL_ERROR, REJECTED or UNEXPECTED."""

    data: DataFrame | None = None
    error: str = ""
    detail: str = ""
    tables: list[str] = field(default_factory=list)
    fetched: list[tuple] | None = None
    whole: Whole | None = None

    @property
    def ok(self) -> bool:
        return not self.error


def split_statements(text: str) -> list[str]:
    """Statements of a text; semicolons in quotes don't count, comments are dropped."""
    parts, now, quote, k = [], "", "", 0
    while k < len(text):
        sign = text[k]
        if quote:
            quote = "" if sign == quote else quote
        elif sign in "'\"`":
            quote = sign
        elif text.startswith("--", k):
            end = text.find("\n", k)
            k = len(text) if end < 0 else end
            continue
        elif text.startswith("/*", k):
            end = text.find("*/", k)
            k = len(text) if end < 0 else end + 2
            continue
        elif sign == ";":
            parts.append(now.strip())
            now, k = "", k + 1
            continue
        now += sign
        k += 1
    return [p for p in (*parts, now.strip()) if p]


def first_select(text: str) -> str:
    """The first statement that is a query, or the whole text."""
    return next((p for p in split_statements(text) if re.match(r"(?i)\(*\s*(select|with|values|from)\b", p)), text.strip())


def _each(sequence):
    return (sequence.apply(k) for k in range(sequence.size()))


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _expressions(plan, subquery: Callable) -> Iterator:
    """All expressions of one plan node; plans inside of them go to `subquery`."""
    stack = [*_each(plan.expressions())]
    while stack:
        e = stack.pop()
        yield e
        stack += _each(e.children())
        if is_instance_of(_gateway(), e, "org.apache.spark.sql.catalyst.expressions.PlanExpression"):
            subquery(e.plan())


def _gateway():
    return SparkContext._gateway


def _walk(plan, plans: list, expressions: list, scope: frozenset = frozenset()) -> None:
    """All plan nodes under a parsed plan, each with the names of CTEs in scope, and all expressions; CTEs and subqueries included."""
    plans.append((plan, scope))
    if plan.nodeName() == "UnresolvedWith":  # a CTE sees those before it, and itself if recursive; the query sees all
        for cte in _each(plan.innerChildren()):
            own = frozenset({cte.alias().lower()})
            _walk(cte, plans, expressions, scope | own if plan.allowRecursion() else scope)
            scope |= own
    expressions += _expressions(plan, lambda below: _walk(below, plans, expressions, scope))
    for child in _each(plan.children()):
        _walk(child, plans, expressions, scope)


def _parsed(spark: SparkSession, sql: str) -> tuple[list, list]:
    plans: list = []
    expressions: list = []
    _walk(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql), plans, expressions)
    return plans, expressions


@cache
def _function_group(name: str) -> str:
    """Group of a built-in function; empty for one that isn't built in."""
    catalyst = SparkContext._jvm.org.apache.spark.sql.catalyst
    found = catalyst.analysis.FunctionRegistry.builtin().lookupFunction(catalyst.FunctionIdentifier(name))
    return found.get().getGroup() if found.isDefined() else ""


def inspect(spark: SparkSession, sql: str, tables: set[str], columns: frozenset[str] = frozenset()) -> Outcome:
    """Parse only. Anything but query nodes over the named tables, or CTEs in their scope, and built-in functions of the allowed
    groups is rejected, as is any doubt. An alias is never a table. `columns`, in lower case, may be named as the user is."""
    try:
        plans, expressions = _parsed(spark, sql)
    except Exception as error:
        name = "SQL_ERROR" if "ParseException" in str(error) or isinstance(error, ParseException) else "REJECTED"
        return Outcome(error=name, detail=str(error).splitlines()[0][:300])
    known = {t.lower() for t in tables}
    used = []
    for p, scope in plans:
        kind = p.nodeName()
        if kind not in QUERY_NODES:
            return Outcome(error="REJECTED", detail=f"not a query: {kind}")
        if kind == "UnresolvedRelation":
            parts = [*_each(p.multipartIdentifier())]
            if len(parts) != 1 or parts[0].lower() not in known | scope:
                return Outcome(error="REJECTED", detail=f"no such table: {'.'.join(parts)}")
            if parts[0].lower() not in scope:
                used.append(parts[0])
    for e in expressions:
        kind = _kind(e)
        if kind in BARRED_EXPRESSIONS or kind == "UnresolvedAttribute" and [*_each(e.nameParts())][-1].lower() in BARRED_ATTRIBUTES - columns:
            return Outcome(error="REJECTED", detail=f"not allowed: {e.toString()}")
        if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
            parts = [*_each(e.nameParts())] if kind == "UnresolvedFunction" else [e.name().funcName()]
            if len(parts) != 1 or _function_group(parts[0].lower()) not in FUNCTION_GROUPS:
                return Outcome(error="REJECTED", detail=f"function not allowed: {'.'.join(parts)}")
    return Outcome(tables=used)


def _span(e) -> tuple[int, int] | None:
    at, end = e.origin().startIndex(), e.origin().stopIndex()
    return (at.get(), end.get() + 1) if at.isDefined() and end.isDefined() else None


def typed_edits(spark: SparkSession, sql: str, analysed) -> str:
    """Rewrites that depend on types, which the analysed plan has: whole numbers divide without a rest, and sums and means of texts
    count the number that each text begins with. The parsed plan has the operands' places in the text."""
    plans: list = []
    found: list = []
    _walk(analysed, plans, found)
    whole, texts = set(), set()
    is_whole = lambda c: _kind(c) == "Cast" and c.child().dataType().typeName() in ("byte", "short", "integer", "long")
    for e in found:
        if _kind(e) == "Divide" and is_whole(e.left()) and is_whole(e.right()):
            whole.add(_span(e))
        elif _kind(e) in ("Sum", "Average") and _kind(e.child()) == "Cast" and e.child().child().dataType().typeName() == "string":
            texts.add(_span(e))
    edits: list[tuple[int, int, str]] = []
    for e in _parsed(spark, sql)[1] if whole | texts else []:
        if _kind(e) == "Divide" and _span(e) in whole and (left := _span(e.left())) and (right := _span(e.right())):
            edits.append((at := sql.index("/", left[1], right[0]), at + 1, " div "))
        elif _kind(e) == "UnresolvedFunction" and _span(e) in texts and (inner := _span(e.arguments().apply(0))):
            edits.append((*inner, dialect.number_text(sql[slice(*inner)])))
    for at, end, new in sorted(edits, reverse=True):
        sql = sql[:at] + new + sql[end:]
    return sql


def execute(spark: SparkSession, sql: str, tables: dict[str, DataFrame], rewrite: bool = True) -> Outcome:
    """Run the first query of a text over the tables, or say why not. The result is lazy; its schema is already analysed.

    It runs in a child session, with the dialect's casts, that has these tables and nothing else: views and functions of the
    caller's session are neither seen nor replaced.
    """
    sql = first_select(sql)
    sql = dialect.rewrite(sql) if rewrite else sql
    child = dialect_session(spark)
    found = inspect(child, sql, set(tables), frozenset(c.lower() for df in tables.values() for c in df.columns))
    if not found.ok:
        return found
    for name, df in tables.items():
        classic = getattr(spark._jvm.org.apache.spark.sql.classic, "Dataset$").__getattr__("MODULE$")
        classic.ofRows(child._jsparkSession, df._jdf.queryExecution().analyzed()).createOrReplaceTempView(name)
    try:
        out = child.sql(sql)
        while rewrite and (edited := typed_edits(child, sql, out._jdf.queryExecution().analyzed())) != sql:
            sql = edited  # a quotient of whole numbers is one itself
            out = child.sql(sql)
        return Outcome(data=out, tables=found.tables)
    except (AnalysisException, ParseException) as error:
        missing = "UNRESOLVED_COLUMN" in str(error) or "FIELD_NOT_FOUND" in str(error)
        return Outcome(error="NO_SUCH_COLUMN" if missing else "SQL_ERROR", detail=str(error).splitlines()[0][:300])
    except PySparkException as error:
        return Outcome(error="UNEXPECTED", detail=str(error)[:300])


def rows(outcome: Outcome, most: int = 10_000) -> Outcome:
    """Fetch at most `most` rows (a bound for the caller's screen, not for the query); run-time errors become values."""
    if outcome.data is not None:
        try:
            outcome.fetched = [tuple(r) for r in outcome.data.limit(most).collect()]
        except FAILURES as error:
            return Outcome(error="SQL_ERROR", detail=str(error).splitlines()[0][:300])
    return outcome


def plain_cell(c: Column, kind: T.DataType) -> Column:
    """A cell as votes compare it: numbers to two places in full, without trailing zeros; other cells stripped; null is empty."""
    text = c.cast("string")
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        value = text.try_cast("decimal(38,18)") if isinstance(kind, T.FloatType) else c
        fixed = F.round(value, 2) if isinstance(kind, T.DecimalType) else F.round(value, 2).try_cast("decimal(38,2)")
        fixed = F.regexp_replace(F.regexp_replace(fixed.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        text = F.coalesce(fixed, text)
    return F.coalesce(strip(text), F.lit(""))


def whole(outcome: Outcome, most: int = 10_000) -> Outcome:
    """Count and digest all rows distributedly, and fetch at most `most` distinct ones to show, those with text first; run-time
    errors become values. The result is held while it is read, so that all figures are of the same rows."""
    if outcome.data is None:
        return outcome
    kinds = [f.dataType for f in outcome.data.schema]
    names = [f"c{k}" for k in range(len(kinds))]
    held = outcome.data.toDF(*names).persist()
    try:
        texts = F.array(*[F.col(n).cast("string") for n in names])
        plain = F.to_json(F.array(*[plain_cell(F.col(n), k) for n, k in zip(names, kinds, strict=True)]))
        full = F.exists(texts, lambda x: F.coalesce(strip(x) != "", F.lit(False)))
        rows_ = held.select(F.struct(*names).alias("row"), F.to_json(texts, {"ignoreNullFields": "false"}).alias("text"), full.alias("full"), plain.alias("plain"))
        distinct = rows_.groupBy("text").agg(F.any_value("row").alias("row"), F.any_value("full").alias("full"))
        count, full_count = distinct.agg(F.count("*"), F.count_if("full")).first()
        half = lambda at: F.sum(F.conv(F.substring(F.md5("plain"), at, 16), 16, 10).cast("decimal(38,0)"))
        digest = rows_.select("plain").distinct().agg(F.count("*"), half(1), half(17)).first()
        outcome.whole = Whole(outcome.data, count, full_count, tuple(digest))
        outcome.fetched = [tuple(r["row"]) for r in distinct.orderBy(F.desc("full"), "text").limit(most).collect()]
    except FAILURES as error:
        return Outcome(error="SQL_ERROR", detail=str(error).splitlines()[0][:300])
    finally:
        held.unpersist()
    return outcome


def where_literals(spark: SparkSession, sql: str) -> list[tuple[str, str]]:
    """(column, text) of every equality and membership test of a query with a text literal, from its parsed plan."""
    try:
        _, expressions = _parsed(spark, sql)
    except Exception:
        return []
    out = []
    negated = {e.children().apply(0).toString() for e in expressions if e.getClass().getSimpleName() == "Not"}
    for e in expressions:
        if e.getClass().getSimpleName() in ("EqualTo", "In") and e.toString() not in negated:
            parts = [*_each(e.children())]
            names = [p for p in parts if p.getClass().getSimpleName() == "UnresolvedAttribute"]
            values = [p for p in parts if p.getClass().getSimpleName() == "Literal" and p.dataType().typeName() == "string"]
            if len(names) == 1:
                out += [([*_each(names[0].nameParts())][-1], v.value().toString()) for v in values]
    return out


def missing_literals(df: DataFrame, pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The (column, text) pairs whose text is in no row of the column, in one pass: a maximum of each test."""
    known = [(c, v) for c, v in dict.fromkeys(pairs) if c in df.columns]
    if not known:
        return []
    hit = df.agg(*[F.max((F.col(f"`{c}`").cast("string") == v).cast("int")).alias(f"t{k}") for k, (c, v) in enumerate(known)]).first()
    return [p for k, p in enumerate(known) if not hit[k]]


__all__ = ["Outcome", "execute", "first_select", "inspect", "missing_literals", "rewrite_dialect", "rows", "split_statements", "typed_edits", "where_literals", "whole"]
