"""Queries and results that cover all of their input, against plain Python or SQL that names no column by hand."""

import re
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from lakeask import catalogue
from lakeask.catalogue import METADATA, QUERIES
from lakeask.functions import text
from lakeask.plans import ask, models, sqlgate


def ranked_in_python(spark, sf):
    """question_id to all columns by the character Jaccard of the whole question."""
    form = lambda t: set(re.sub(r"[^\w]", "", t.replace("ß", "s")).upper())
    out = {}
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        asked = form(r["text"])
        score = {c: round(len(asked & form(t)) / len(asked | form(t)), 6) for c, t in METADATA}
        out[r["item_id"]] = sorted(score, key=lambda c: (-score[c], c))
    return out


def test_columns_are_ranked_on_whole_questions(spark, sf):
    want = ranked_in_python(spark, sf)
    got = {}
    for r in QUERIES["link_rank_topk"](spark, sf).orderBy("question_id", "rank").collect():
        got.setdefault(r["question_id"], []).append(r["column_name"])
    assert got == {q: c[:6] for q, c in want.items()}
    made = QUERIES["negatives_hard_easy"](spark, sf).select("sample_id", "column_name").collect()
    assert made and not [r for r in made if r["column_name"] in want[r["sample_id"]][:2]]


@pytest.fixture(scope="module")
def engine(spark):
    table = spark.range(10_050).select("id", F.lit(1234567).alias("n")).cache()
    meta = spark.createDataFrame([("id", "key"), ("n", "number")], "column_name string, column_description string")
    return ask.Engine(spark, table, "big", meta, models.Scripted({"all": "SELECT id FROM big", "no": "SELECT id FROM big WHERE id < 0"}), k=2)


def test_votes_see_rows_beyond_those_shown(engine):
    up, down = (engine.try_sql(p, f"SELECT id FROM big ORDER BY id {p}") for p in ("ASC", "DESC"))
    assert ask.agreed([up, down])
    short = engine.try_sql("ICL_Path", "SELECT id FROM big WHERE id < 10020 ORDER BY id")
    assert short.votable and not ask.agreed([up, short])
    twice = engine.try_sql("ICL_Path", "SELECT id FROM big UNION ALL SELECT id FROM big")
    assert ask.agreed([up, twice])


def test_whole_results_are_counted_and_cuts_are_marked(engine):
    for found in (engine.ask("all"), engine.baseline("all")):
        assert found["unique_rows_count"] == 10_050 and found["cut"] and len(found["execution_result"]) == 10_000
        assert found["result"].count() == 10_050
    assert engine.baseline("no")["execution_result"] == [] and "cut" not in engine.baseline("no")
    odd = engine.try_sql("x", "SELECT * FROM (VALUES (array(1), map('a', 1), NULL, ' '), (array(1), map('a', 1), NULL, '')) AS v(a, m, n, n)")
    assert odd.status == "success" and odd.whole.rows == 2 and odd.whole.full_rows == 2
    assert not engine.try_sql("x", "SELECT ' ' AS a, NULL AS b").votable
    assert engine.try_sql("x", "SELECT (SELECT id FROM big) AS a").error.startswith("SQL_ERROR")


def test_votes_compare_numbers_in_full(engine):
    made = lambda *cells: ask.Candidate("p", "", "success", [(c,) for c in cells])
    assert not ask.agreed([made(1234567), made(1234568)]) and not ask.agreed([made(2**53), made(2**53 + 1)])
    assert ask.agreed([made(1234567), made(1234567.0)]) and ask.agreed([made(0.125), made(Decimal("0.130"))])
    ran = lambda sql: engine.try_sql("p", f"SELECT {sql} AS v")
    assert not ask.agreed([ran("1234567"), ran("1234568")]) and not ask.agreed([ran("1234567.25D"), ran("1234567.35D")])
    assert ask.agreed([ran("1234567"), ran("1234567.001D"), ran("1")])


def test_cells_read_alike_on_driver_and_executors(spark):
    cells = {"double": [1234567.0, 2.5, 100.0, -0.001, 1.005, 1e22, 1e-7, 123456789.126, 0.0], "long": [0, -7, 10**18 + 1], "decimal(20,4)": [Decimal("1.5000"), Decimal("-2.0050"), Decimal("100.0000")], "string": [" x ", "1.50", ""], "boolean": [None]}
    for kind, values in cells.items():
        df = spark.createDataFrame([(v,) for v in values], f"c {kind}")
        got = [r[0] for r in df.select(sqlgate.plain_cell(F.col("c"), df.schema["c"].dataType)).collect()]
        assert got == [ask.plain_cell(v) for v in values]
    assert [ask.plain_cell(v) for v in (1234567.0, 2.5, 100, -0.001, 1.005)] == ["1234567", "2.5", "100", "0", "1.01"]


def test_profiles_cover_every_scalar_column_of_every_table(spark, sf):
    from pathlib import Path

    con = duckdb.connect()
    want = {}
    for path in Path(sf).glob("*.parquet"):
        for name, kind, *_ in con.sql(f"DESCRIBE SELECT * FROM '{path}'").fetchall():
            if not kind.endswith("]"):
                text = catalogue._sql_text(name, {"DOUBLE": "d", "TIMESTAMP": "t"}.get(kind, "s"))
                long = f"SELECT '{name}' AS \"column\", nullif({catalogue.sql_strip(text)}, '') AS value FROM '{path}'"
                row = con.sql(f"SELECT * FROM ({catalogue._sql_profile(long)})")
                want[path.stem, name] = dict(zip(row.columns, row.fetchall()[0], strict=True))
    got = {(r["table"], r["column"]): r.asDict() for r in QUERIES["profile_all"](spark, sf).collect()}
    assert {k: {c: v for c, v in r.items() if c != "table"} for k, r in got.items()} == want and len({t for t, _ in want}) == 14
    for name in ("documents", "lineitem"):
        assert {r["column"]: r.asDict() for r in QUERIES[f"profile_{name}"](spark, sf).collect()} == {c: r for (t, c), r in want.items() if t == name}
    ranges = {tuple(r) for r in QUERIES["profile_numeric_range"](spark, sf).select("column", "min_value", "max_value").collect()}
    assert ranges == {(c, r["min_value"], r["max_value"]) for (t, c), r in want.items() if t == "lineitem" and r["data_type"] == "NUMERIC"} and len(ranges) == 8


def test_slots_are_filled_from_each_row(spark, sf):
    part = {r["p_partkey"]: f"brand {r['p_brand']} of type {r['p_type']}" for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    assert {r[0]: r[1] for r in QUERIES["text_fill_slots"](spark, sf).collect()} == part
    df = spark.createDataFrame([("{b}", "x"), (None, "$1\\")], "a string, b string")
    filled = text.fill_slots(F.lit("{a}, {b}{b} {c} {{b}}"), {"a": F.col("a"), "b": F.col("b")})
    assert [r[0] for r in df.select(filled).collect()] == ["{b}, xx {c} {x}", ", $1\\$1\\ {c} {$1\\}"]
