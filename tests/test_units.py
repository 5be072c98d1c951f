"""Scalar functions, templates, gate, sources and the asking loop against plain Python."""

import json
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lakeask.functions import arrow, text as X
from lakeask.operators import dataset, linking, profile, retrieve, values, vote
from lakeask.plans import ask, models, replies, sqlgate, template
from lakeask.sources import tables
from lakeask.streaming import ingest


def column(spark, cells, function):
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cells)], "k int, c string")
    return [r[1] for r in df.select("k", function(F.col("c"))).orderBy("k").collect()]


@pytest.mark.parametrize(
    ("function", "cells", "want"),
    [
        (X.half_width, ["ＡＢＣ　１２３，。", None, " a \t b ", "“x”【y】、；："], ["ABC 123,.", "", "a b", '"x"[y],;:']),
        (X.strip_invisible, ["a​b﻿", "x\U000f0001", None, "\x00\x1fa\x7f‮"], ["ab", "x", "", "a"]),
        (X.strip, ["　 a\t", "\x1ca\x85", "\n"], ["a", "a", ""]),
        (X.clean_value, [" NaN", "n/a", "12.0", "007", "1.50", None, "None"], ["", "", "12", "007", "1.50", "", ""]),
        (X.clean_number_text, ["1,234.0", "a,b", "1,5", "12"], ["1234", "a,b", "15", "12"]),
        (X.drop_dot_zero, ["qty 12.0, 3.05", "编号123.0", "v1.0", "7.0"], ["qty 12, 3.05", "编号123.0", "v1.0", "7"]),
        (X.is_numeric, ["1", " -2.5e3 ", "1d", "1_000", ".5", "", None, "nan"], [True, True, False, False, True, False, False, False]),
        (X.number, ["1", "1d", " 2.5 "], [1.0, None, 2.5]),
        (X.format_class, ["2024/1/2", "2024-01-02", "123", "A12", "x", "2024-01-02 10"], ["YYYY/MM/DD", "YYYY-MM-DD", "纯数字", "编码(字母+数字)", None, None]),
        (X.match_form, ["a-b 中文_1", "!!", None], ["AB中文_1", "", ""]),
        (X.placeholders, ["{a} {b} {a}", "none"], [["a", "b", "a"], []]),
        (X.placeholder_columns, ["{b,a}{c，a | d > 3}", ""], [["a", "b", "c"], []]),
        (X.code_tokens, ["AB12 12345 123456 A1 x9y AB12", ""], [["AB12", "123456", "x9y"], []]),
        (X.cell_text, ["1.005", "2.50", "100.0", " x ", None, "-0.10"], ["1.01", "2.5", "100", "x", "", "-0.1"]),
        (X.truth_items, ["b，a;100.0；a", ""], [["100", "a", "b"], []]),
        (X.list_line, ["1. **bold** text", "2、x"], ["bold text", "x"]),
        (X.extract_sql, ["<think>SELECT 2</think>```sql\nSELECT 1;\n```", "```\nSELECT 3\n```", "so SELECT 4 ;", "nothing"], ["SELECT 1", "SELECT 3", "SELECT 4", ""]),
        (X.remove_spaces, ["a　b c"], ["abc"]),
    ],
)
def test_text(spark, function, cells, want):
    assert column(spark, cells, function) == want


def test_similarities(spark):
    df = spark.createDataFrame([("abc", "abd", [1.0, 0.0], [1.0, 1.0]), ("", "", [0.0], [1.0]), ("a" * 250 + "b", "b" + "a" * 250, None, None)], "a string, b string, u array<double>, v array<double>")
    rows = df.select(X.jaccard(X.characters(F.col("a")), X.characters(F.col("b"))), X.coverage(X.characters(F.col("a")), X.characters(F.col("b"))), arrow.sequence_ratio()("a", "b"), X.cosine(F.col("u"), F.col("v"))).collect()
    assert rows[0][:3] == (0.5, 2 / 3, SequenceMatcher(None, "abc", "abd").ratio()) and rows[0][3] == pytest.approx(0.5**0.5)
    assert rows[1][:2] == (0.0, 0.0) and rows[1][3] is None
    assert rows[2][2] == SequenceMatcher(None, "a" * 250 + "b", "b" + "a" * 250).ratio()


def test_prefixes_lose_no_near_value(spark):
    import itertools
    import random

    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 9))) for _ in range(120)]
    kw, vals = words[:40], sorted(set(words[40:]))
    got = {(r["keyword"], r["value"]) for r in values.near(spark.createDataFrame([(k,) for k in set(kw)], "keyword string"), spark.createDataFrame([("c", v) for v in vals], "column string, value string")).collect()}
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    assert got == {(k, v) for k, v in itertools.product(set(kw), vals) if jac(k, v) >= 0.75} and got


@pytest.mark.parametrize(
    ("reply", "want"),
    [('x ["a", "b",] y', ["a", "b"]), ("['a', ['b']]", ["a", "b"]), ("<think>[1]</think>[\"c\", 2]", ["c", "2"]), ("none", None), (None, None), ('["a]b"]', ["a]b"]), ("[]", [])],
)
def test_text_list(reply, want):
    assert replies.text_list(reply) == want


@pytest.mark.parametrize(
    ("answer", "kind"),
    [("count{}", "count"), ("SUM{a}", "sum"), ("avg{a}", "avg"), ("count1{a | b >= 2}", "count1"), ("listdown{m}{g, h}*3", "list"), ("listup{count}{g}**", "list"), ("{a}{b}", "project"), ("{a，b}", "project")],
)
def test_parse(answer, kind):
    tree = template.parse("{q} and {q} and {r}", answer)
    assert tree.kind == kind and dict(tree.fields) == {"q": 2, "r": 1}


@pytest.mark.parametrize("answer", ["median{x", "", "listdown{a}*3", "sum{a | b > 1}", "count1{a | b ~ 1}", "{,}{，}", "count1{a | b > x}"])
def test_unreadable_templates(answer):
    with pytest.raises(template.TemplateError):
        template.parse("", answer)


def test_ascii_comma_stays_in_a_projected_name():
    assert template.parse("", "{a,b}").groups == ("a,b",) and template.parse("", "{a，b}").groups == ("a", "b")


@given(st.sampled_from(["count{}", "sum{v}", "avg{v}", "count1{t}", "count1{t | v > 2}", "listdown{v}{t}*2", "listup{count}{t}**", "{t}{u}"]), st.sampled_from(["", "{u}", "{u} {u}"]), st.lists(st.tuples(st.sampled_from(["a", "b", " ", "it's"]), st.sampled_from(["x", "y\\z", ""]), st.one_of(st.none(), st.integers(-5, 5).map(lambda n: n / 4))), min_size=1, max_size=6))
@settings(max_examples=12, deadline=None)
def test_templates_agree_as_dataframe_and_sql(spark, answer, question, rows):
    df = spark.createDataFrame(rows, "t string, u string, v double")
    tree = template.parse(question, answer)
    assert template.dual_check(df, tree, {"u": ["x", "y\\z"]}) == "MATCH"


def test_template_errors_are_values(spark):
    df = spark.range(3).withColumn("t", F.lit("a"))
    assert "no such column" in template.dual_check(df, template.parse("", "sum{zz}"))
    assert "no value for" in template.dual_check(df, template.parse("{t}", "count{}"))


COMMANDS = ["DROP TABLE t", "DELETE FROM t", "UPDATE t SET a = 1", "INSERT INTO t VALUES (1)", "CREATE TABLE x AS SELECT 1", "CREATE VIEW v AS SELECT 1", "ALTER TABLE t ADD COLUMN b int", "TRUNCATE TABLE t", "SET spark.x = 1", "CACHE TABLE t", "ADD JAR 'x'", "USE x", "SHOW TABLES", "MERGE INTO t USING t s ON t.a = s.a WHEN MATCHED THEN DELETE", "EXPLAIN SELECT 1", "SELECT java_method('a', 'b')", "SELECT * FROM csv.`/etc/passwd`", "SELECT * FROM range(5)", "SELECT (SELECT max(a) FROM other)", "SELECT a FROM t WHERE a IN (SELECT b FROM hidden)", "WITH x AS (SELECT * FROM hidden) SELECT * FROM x", "SELECT * FROM t JOIN default.hidden"]


@pytest.mark.parametrize("sql", COMMANDS)
def test_gate_rejects(spark, sql):
    assert sqlgate.inspect(spark, sql, {"t"}).error == "REJECTED"


@pytest.mark.parametrize("sql", ["SELECT a FROM t", "WITH x AS (SELECT a FROM t) SELECT count(*) FROM x GROUP BY a HAVING count(*) > 1 ORDER BY 1 LIMIT 2", "SELECT * FROM t UNION SELECT * FROM t", "SELECT s.a, row_number() OVER (ORDER BY a) FROM (SELECT a FROM t) s", "VALUES (1)", "SELECT a FROM t WHERE EXISTS (SELECT 1 FROM t u WHERE u.a = t.a)", "SELECT delete_time FROM t"])
def test_gate_lets_queries_pass(spark, sql):
    assert sqlgate.inspect(spark, sql, {"t"}).ok


def test_gate_text_handling(spark):
    assert sqlgate.split_statements("SELECT ';' ; -- x;\nSELECT 2") == ["SELECT ';'", "SELECT 2"]
    assert sqlgate.first_select("SET x=1; SELECT 5; SELECT 6") == "SELECT 5"
    assert sqlgate.rewrite_dialect("SELECT a FROM t WHERE a like 'x like y' AND b == 2") == "SELECT a FROM t WHERE a ILIKE 'x like y' AND b = 2"
    assert set(sqlgate.where_literals(spark, "SELECT 1 FROM t WHERE t.a = 'x' AND b <> 'y' AND c >= 'z' AND d IN ('p', 'q') AND 'w' = e")) == {("a", "x"), ("d", "p"), ("d", "q"), ("e", "w")}
    df = spark.createDataFrame([("x", 1)], "a string, n int")
    assert sqlgate.missing_literals(df, [("a", "x"), ("a", "y"), ("zz", "y")]) == [("a", "y")]
    assert sqlgate.rows(sqlgate.execute(spark, "SELECT (SELECT n FROM tt UNION ALL SELECT 2) AS r", {"tt": df})).error == "SQL_ERROR"


def test_csv_ingest_and_sinks(spark, tmp_path):
    source = tmp_path / "in.csv"
    source.write_text(' code ,价,note\n007,"1,234.0","a ""q"" ，b"\nN/A,x,"two\nlines"\n', encoding="utf-8")
    raw = tables.read_csv(spark, str(source))
    assert raw.columns == ["code", "价", "note"] == tables.columns_of(spark, str(source))
    got = [tuple(r) for r in tables.ingest(raw, ["价"]).collect()]
    assert got == [("007", 1234.0, 'a "q" ,b'), (None, None, "two lines")]
    tables.write_csv(raw, f"{tmp_path}/out", ["note", "absent", "code"])
    assert tables.read_csv(spark, f"{tmp_path}/out").columns == ["note", "absent", "code"]
    tables.write_csv(raw, f"{tmp_path}/out", ["note", "absent", "code"], append=True)
    assert tables.read_csv(spark, f"{tmp_path}/out").count() == 4
    tables.write_json_array(raw, f"{tmp_path}/a.json")
    assert len(json.load(open(f"{tmp_path}/a.json", encoding="utf-8"))) == 2 == tables.source(spark, path=f"{tmp_path}/a.json").count()
    tables.write_jsonl(raw, f"{tmp_path}/b")
    assert tables.read_jsonl(spark, train=f"{tmp_path}/b")["train"].count() == 2
    assert tables.read_examples(spark, f"{tmp_path}/absent.csv").count() == 0
    with pytest.raises(ValueError):
        tables.source(spark)
    assert tables.register(raw, "reg", {"code": "int"}).schema["code"].dataType.simpleString() == "int"


def test_schema_text(spark, tmp_path):
    (tmp_path / "s.txt").write_text("header\n(code: TEXT, the code, Examples: [a, b])\n(price: REAL, unit price, Examples: [])\nother\n")
    got = [tuple(r) for r in tables.read_schema_text(spark, f"{tmp_path}/s.txt").collect()]
    assert got == [(1, "code", "TEXT", "the code", ["a", "b"]), (2, "price", "REAL", "unit price", [])]


def test_index_cache(spark, tmp_path):
    index = spark.createDataFrame([("v", ["c"])], "value string, columns array<string>")
    tables.save_index(index, f"{tmp_path}/i", version=2, mtime="t", model="m")
    assert tables.load_index(spark, f"{tmp_path}/i", version=2, mtime="t", model="m").count() == 1
    assert tables.load_index(spark, f"{tmp_path}/i", version=2, mtime="u", model="m") is None
    assert tables.load_index(spark, f"{tmp_path}/none", version=2) is None


def test_stream_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("code,n\nＡ１,2\n", encoding="utf-8")
    stream = ingest.read_arriving_csv(spark, f"{tmp_path}/in", ["code", "n"], ["n"])
    ingest.append_to(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(60)
    (tmp_path / "in/b.csv").write_text("code,n\nb,x\n")
    ingest.append_to(ingest.read_arriving_csv(spark, f"{tmp_path}/in", ["code", "n"], ["n"]), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == [("A1", 2.0), ("b", None)]


def test_profile_of_odd_tables(spark):
    df = spark.createDataFrame([(None, " ", "2024/1/2"), (None, "1", "x")], "a string, b string, c string")
    rows = {r["column"]: r for r in profile.profile(profile.value_counts(df)).collect()}
    assert rows["a"]["null_count"] == 2 and rows["a"]["is_categorical"] and rows["a"]["data_type"] == "TEXT"
    assert rows["b"]["null_ratio"] == 0.5 and rows["b"]["min_value"] == 1.0
    assert profile.profile(profile.value_counts(df.limit(0))).count() == 0


def test_votes(spark):
    rows = [(1, "thinking_path", "f"), (1, "ICL_Path", "g"), (1, "Direct_Path", "g"), (2, "ICL_Path", "f"), (2, "Direct_Path", "g"), (3, "ICL_Path", None)]
    got = {r["q"]: (r["path"], r["status"]) for r in vote.select_best(spark.createDataFrame(rows, "q int, path string, fingerprint string"), ["q"]).collect()}
    assert got == {1: ("ICL_Path", "win"), 2: ("ICL_Path", "tie")}


def test_negatives(spark):
    names = spark.createDataFrame([(f"col_{k}",) for k in range(20)] + [("price_name",)], "column_name string")
    samples = spark.createDataFrame([(1, ["col_1", "col_2"], "q")], "sample_id int, targets array<string>, question string")
    got = dataset.negatives(samples, names).collect()
    assert sum(r["kind"] == "hard" for r in got) == 3 and sum(r["kind"] == "easy" for r in got) == 7 and not {r["column_name"] for r in got} & {"col_1", "col_2"}
    made = dataset.ranker_samples(samples, names).collect()
    assert sum(r["label"] for r in made) == 2 and len(made) == 12
    chat = dataset.schema_samples(samples.withColumn("sql", F.lit("SELECT 1")), names, names.withColumn("column_description", F.lit("d")), "Be brief").first()
    assert [m["role"] for m in chat["messages"]] == ["system", "user", "assistant"] and "(col_1, d)" in chat["messages"][1]["content"]


def test_top_k_of_zero_vectors(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "item_id int, item_vector array<double>")
    got = retrieve.top_k(spark.createDataFrame([(9, [1.0, 0.0])], "query_id int, query_vector array<double>"), items, 3).orderBy("rank").collect()
    assert [r["item_id"] for r in got] == [1, 3, 2]


@pytest.fixture(scope="module")
def engine(spark):
    table = spark.createDataFrame([("A100", "bolt", 2.0), ("B200", "nut", 3.0), ("C300", "bolt", 5.0)], "code string, kind string, price double").cache()
    meta = spark.createDataFrame([("code", "code of the item"), ("kind", "kind of item"), ("price", "price")], "column_name string, column_description string")
    replies_ = {
        "price of A100": "```sql\nSELECT price FROM goods WHERE code = 'A100'\n```",
        "bolts": {"thinking_path": "SELECT count(*) FROM goods WHERE kind = 'bolt'", "ICL_Path": "SELECT 8 AS n", "Direct_Path": "SELECT sum(price) FROM goods WHERE kind = 'bolt'"},
        "loose": "SELECT count(*) AS n, max(code) AS m FROM goods WHERE kind = 'bol'",
        "bad": "SELECT nope FROM goods",
        "evil": "DROP TABLE goods",
    }
    return ask.Engine(spark, table, "goods", meta, models.Scripted(replies_), k=2)


def test_ask(engine):
    found = engine.ask("price of Ａ１００")
    assert found["execution_result"] == [(2.0,)] and found["reason"] == "win" and found["unique_rows_count"] == 1
    assert set(found) == {"final_sql", "execution_result", "unique_rows_count", "reason", "first_inference_time", "repair_times", "cost_time", "token_usage"}


def test_ask_tie_repair_and_failure(engine):
    tie = engine.ask("bolts")
    assert tie["reason"] == "tie" and "count(*)" in tie["final_sql"]
    loose = engine.refine("loose", engine.try_sql("Direct_Path", "SELECT count(*) AS n FROM goods WHERE kind = 'bol'"), "")
    assert loose.rows == [(2,)] and loose.path == "Direct_Path_Refined_1" and len(loose.repair_times) == 1
    assert engine.ask("bad")["reason"] == "no_data" and engine.ask("evil")["execution_result"] == [] and engine.ask("unknown")["reason"] == "all_paths_failed"


def test_link_and_prompt(engine):
    ranked, required, evidence = engine.link("what does B200 cost", ["B200", "bolts"])
    assert {r["column_name"] for r in required.collect()} >= {"code"}
    assert ranked.count() == 3 and evidence.filter("keyword = 'B200'").count() == 1
    prompt = linking.schema_prompt(engine.metadata, ["price", "absent", "code"], engine.inline, "db", "goods")
    assert prompt.index("(price") < prompt.index("(code") and "absent" not in prompt and "NUMERIC" in prompt


def test_baseline(engine):
    assert engine.baseline("price of A100")["execution_result"] == [(2.0,)] == engine.baseline("price of A100", pruned=True)["execution_result"]


def test_stand_ins(monkeypatch):
    assert models.CodeEntities().extract("code AB12 of 'steel pipe' in 2022", "") == ["steel pipe", "AB12"]
    assert models.LooseMatch().repair("", "SELECT 1 FROM t WHERE a = 'x'", "", "") == "SELECT 1 FROM t WHERE a LIKE '%x%'"
    monkeypatch.delenv("LLM_BASE_URL", raising=False)
    with pytest.raises(KeyError):
        models.Endpoint.from_environment()
    tokens = models.Tokens()
    tokens.track(3, 4)
    assert tokens.report() == {"input_tokens": 3, "output_tokens": 4, "total_tokens": 7}
