"""The asking loop's threads, the dataset driver, the evaluation loop, the dialect and what else a caller leans on."""

import json
import time

import pytest
from pyspark.sql import functions as F

from lakeask.operators import evaluate, linking, profile, values
from lakeask.plans import ask, dialect, generate, models, sqlgate, template
from lakeask.sources import tables


class Slow:
    """Fast paths agree at once; the thinking one takes long. Notes the temperatures it is asked with."""

    def __init__(self, seconds=20.0, broken=()):
        self.seconds, self.broken, self.heat = seconds, broken, {}

    def generate(self, path, question, schema, evidence, examples, temperature):
        self.heat[path] = temperature
        if path in self.broken:
            raise ConnectionError("no model")
        if path.startswith("thinking"):
            time.sleep(self.seconds)
        return "SELECT count(*) AS n FROM goods"


@pytest.fixture(scope="module")
def goods(spark):
    return spark.createDataFrame([("A100", "bolt", 2.0), ("B200", "nut", 3.0), ("C300", "bolt", 5.0)], "code string, kind string, price double").cache()


@pytest.fixture(scope="module")
def meta(spark):
    return spark.createDataFrame([("code", "code of the item", ["A1", "B2", "C3"]), ("kind", "kind of item", None)], "column_name string, column_description string, examples array<string>")


def test_agreeing_fast_paths_end_the_wait(spark, goods, meta):
    model = Slow()
    engine = ask.Engine(spark, goods, "goods", meta, model, k=2)
    began = time.time()
    found = engine.candidates("how many", "", "")
    assert time.time() - began < 15 and [c.path for c in found] == ["ICL_Path", "Direct_Path"] and ask.agreed(found)
    assert model.heat == {"thinking_path": 0.5, "ICL_Path": 0.1, "Direct_Path": 0.4}


def test_a_failing_path_is_left_out(spark, goods, meta):
    engine = ask.Engine(spark, goods, "goods", meta, Slow(0, ("ICL_Path",)), k=2)
    found = engine.ask("how many")
    assert found["execution_result"] == [(3,)] and found["reason"] == "win" and set(engine.failures) == {"ICL_Path"}
    assert ask.Engine(spark, goods, "goods", meta, Slow(0, tuple(models.PATHS)), k=2).ask("how many")["reason"] == "all_paths_failed"


def test_the_index_is_read_again(spark, goods, meta, tmp_path):
    make = lambda df, stamp: ask.Engine(spark, df, "goods", meta, Slow(), cache=f"{tmp_path}/i", stamp={"version": stamp})
    assert make(goods, "1").index.filter("value = 'A100'").count() == 1
    other = goods.withColumn("code", F.lit("Z9"))
    assert make(other, "1").index.filter("value = 'Z9'").count() == 0 and make(other, "2").index.filter("value = 'Z9'").count() == 1


def test_entities_are_asked_for_twice_and_filtered():
    replies = iter(["no list", 'Sure: ["A100", "code", "zz", "JSON A100", " bolt。"]'])
    assert models.ModelEntities(lambda q, s: next(replies), ["code"]).extract("code A 100 of bolt, JSON A100", "") == ["A100", "bolt"]

    def fails(question, schema):
        raise TimeoutError

    assert models.ModelEntities(fails).extract("what is AB12", "") == ["AB12"]


def test_dataset_resumes_and_counts(spark, goods, tmp_path):
    asked = spark.createDataFrame([("how many {kind}", "count{}"), ("codes of {kind}", "{code}"), ("price of {zz}", "sum{price}"), ("bad", "nope{"), (" ", "count{}"), ("{kind} or {kind}", "count{}")], "question_template string, answer_template string")
    path = f"{tmp_path}/set"
    first = generate.extend(spark, path, goods, asked.limit(1), "code", target=2)
    assert first == {"success": 1, "skipped_full": 0, "skipped_no_data": 0, "skipped_sql_fail": 0, "errors": 0, "saved_rows": 2}
    again = generate.extend(spark, path, goods, asked, "code", target=2)
    assert again == {"success": 2, "skipped_full": 1, "skipped_no_data": 0, "skipped_sql_fail": 0, "errors": 2, "saved_rows": 3}
    rows = {r["filled_question"]: r for r in spark.read.parquet(path).collect()}
    assert rows["codes of bolt"]["answer"] == "A100，C300" and {q: r["answer"] for q, r in rows.items() if q.startswith("how many")}.items() <= {"how many nut": "1", "how many bolt": "2"}.items() and rows["bolt or nut"]["answer"] == "3"
    assert all(r["status"] == "MATCH" and r["valid"] for r in rows.values()) and json.loads(rows["bolt or nut"]["slots"]) == {"kind": ["bolt", "nut"]}
    grown = generate.extend(spark, path, goods, asked.limit(1), "code", target=3)
    assert grown["saved_rows"] <= 1 and generate.extend(spark, path, goods, asked.limit(1), "code", mode="overwrite", target=1)["saved_rows"] == 1
    with pytest.raises(ValueError):
        generate.extend(spark, path, goods, asked, "code", mode="append")


def test_evaluation_writes_its_errors(spark, tmp_path):
    asked = spark.createDataFrame([("a", "1，2.50"), ("b", "x|1"), ("c", "3"), ("d", "")], "question string, truth string")

    def system(question):
        if question == "c":
            raise ConnectionError("gone")
        return {"a": {"execution_result": [(2.5,), (1,)], "repair_times": [0.5, 1.5], "cost_time": 2}, "b": {"execution_result": [("x", 2)], "final_sql": "SELECT"}, "d": {"execution_result": [(None,)]}}[question]

    found = evaluate.run(system, asked, f"{tmp_path}/errors.json")
    assert (found["total"], found["correct"], found["repairs"], found["mean_repair_s"]) == (4, 2, 2, 1.0)
    said = json.load(open(f"{tmp_path}/errors.json", encoding="utf-8"))
    assert said == found["errors"] and [(e["question"], e["predicted"], "error" in e) for e in said] == [("b", ["x|2"], False), ("c", [], True)]


def test_dialect_by_tokens():
    assert dialect.rewrite("SELECT \"a\"\"b\" FROM t WHERE x LIKE 'max(1,2) like' AND max(y) == 2") == "SELECT `a\"b` FROM t WHERE x ILIKE 'max(1,2) like' AND max(y) = 2"
    assert "LISTAGG(DISTINCT CAST(a AS STRING), ',')" in dialect.rewrite("SELECT group_concat(DISTINCT a) FROM t")
    assert dialect.rewrite("SELECT strftime('%Q', d), date(d, 'weekday 0')") == "SELECT strftime('%Q', d), date(d, 'weekday 0')"
    assert dialect.glob_pattern("a*[0-9]?.") == r"^a(?s:.*)[0-9](?s:.)\.$"
    assert dialect.arguments("a, f(b, ','), 'x,y'") == ["a", "f(b, ',')", "'x,y'"]


def test_candidates_see_only_what_is_handed_in(spark, goods):
    spark.range(7).createOrReplaceTempView("goods")
    spark.range(3).createOrReplaceTempView("hidden")
    run = lambda sql: sqlgate.rows(sqlgate.execute(spark, sql, {"goods": goods}))
    assert run("SELECT count(*) FROM goods").fetched == [(3,)] and spark.table("goods").count() == 7  # the caller's view stays
    for sql in ("SELECT * FROM hidden AS hidden", "WITH x AS (SELECT * FROM hidden) SELECT * FROM x", "SELECT (SELECT max(id) FROM hidden) FROM goods", "SELECT * FROM goods JOIN LATERAL (SELECT * FROM hidden)"):
        assert run(sql).error == "REJECTED"
    spark.udf.register("leak", lambda: "x")
    assert run("SELECT leak()").error == "REJECTED"
    assert run("SELECT \"no such\" FROM goods").error == "NO_SUCH_COLUMN"
    assert run("SELECT 1/0 AS a, 7/2 AS b, 7/2.0 AS c, 'abc' = 5 AS d").fetched[0][:2] == (None, 3)


def test_slots_and_groups_are_compared_stripped(spark):
    rows = [(" F ", "x", "1.5"), ("F", " ", "2"), ("F　", None, "3"), ("G", "x", "4"), ("F", "y", "none"), ("F", "x", None)]
    df = spark.createDataFrame(rows, "s string, g string, v string")
    tree = template.parse("of {s}", "listdown{v}{g}*9")
    assert [tuple(r) for r in template.to_dataframe(df, tree, {"s": ["F "]}).collect()] == [("x", 1.5)]
    assert template.dual_check(df, tree, {"s": ["F"]}) == "MATCH" == template.dual_check(df, template.parse("{s}", "*"), {"s": [" F"]})
    assert template.to_dataframe(df, template.parse("{s}", "count{}"), {"s": ["F"]}).first()[0] == 5
    plan = template.to_dataframe(tables.ingest(df), template.parse("{s}", "count{}"), {"s": ["F"]})
    assert "regexp" not in template.filtered(tables.ingest(df), template.parse("{s}", "count{}"), {"s": ["F"]})._jdf.queryExecution().analyzed().condition().toString() and plan.first()[0] == 5
    wide = spark.createDataFrame([(1e15,), (2e15,), (0.00001,)], "n double")
    assert template.to_dataframe(wide, template.parse("", "sum{n}")).first()[0] == 3e15
    assert profile.profile(profile.value_counts(spark.createDataFrame([(1e15,), (1e30,)], "n double"))).first()["max_value"] == 1e30


def test_near_values_lose_nothing(spark):
    words = ["abcd", "abce", "bcda", "xyz", "zyxw", "aab", "ab", "漢字表", "漢字", "abcdefgh", "abcdefg", "q"]
    kw = spark.createDataFrame([(w,) for w in words], "keyword string")
    held = spark.createDataFrame([(f"c{k % 3}", w) for k, w in enumerate(words)], "column string, value string")
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = {(a, f"c{k % 3}", b) for a in words for k, b in enumerate(words) if len(b) >= 2 and jac(a.upper(), b.upper()) >= 0.75}
    assert {(r["keyword"], r["column"], r["value"]) for r in values.near(kw, held).collect()} == want


def test_small_library_forms(spark, goods, meta):
    raw = spark.createDataFrame([("1,000", "x", " "), ("2.5", "7", None), ("N/A", "8", "")], "a string, b string, c string")
    assert tables.infer_numeric(raw) == ["a"] and set(tables.infer_numeric(raw, 0.6)) == {"a", "b"} and tables.infer_numeric(spark.range(1)) == []
    assert tables.drop_blank_rows(raw, ["c"]).count() == 0 and tables.drop_blank_rows(raw).count() == 3
    assert [r[0] for r in tables.distinct_sample(goods, "kind").collect()] == ["bolt", "nut"]
    assert linking.selector_listing(meta, ["kind", "nope", "code"]) == "[Schema Candidates]\n- kind: kind of item (Ex: )\n- code: code of the item (Ex: A1, B2)"
    shown = profile.preview(goods)
    assert "code | type=TEXT | distinct=3 | common=[A100, B200, C300]" in shown and "price | type=NUMERIC | distinct=3" in shown and "range=[2.00, 5.00]" in shown and "  kind: ['bolt', 'nut']" in shown
    names = ["code", "kind"]
    assert {linking.schema_prompt(meta, names, shuffle=str(k)).index("(kind") > linking.schema_prompt(meta, names, shuffle=str(k)).index("(code") for k in range(12)} == {True, False}


def test_queries_meet_items_in_blocks(spark, monkeypatch):
    from lakeask.operators import retrieve

    rows = [(k, [float(k % 7), float(k % 5) + 1, 1.0]) for k in range(60)]
    items = spark.createDataFrame(rows, "item_id int, item_vector array<double>")
    queries = items.toDF("query_id", "query_vector")
    want = sorted(map(tuple, retrieve.top_k(queries, items).collect()))
    monkeypatch.setattr(retrieve, "BLOCK", 13)
    assert sorted(map(tuple, retrieve.top_k(queries, items).collect())) == want and len(want) == 180
