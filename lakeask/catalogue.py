"""Queries over the driver's tables for every operator, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeask.functions import arrow, text as X
from lakeask.operators import dataset, evaluate, linking, profile, retrieve, values, vote
from lakeask.plans import generate, sqlgate, template
from lakeask.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        key = name or function.__name__
        QUERIES[key] = function
        if sql:
            SQL[key] = sql
        return function

    return add


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_strip(e: str) -> str:
    return f"regexp_replace({e}, {literal(f'^{X.SPACE}+|{X.SPACE}+$')}, '', 'g')"


# --- answer templates -------------------------------------------------------------------------------------------------

NUMBERS = {
    "orders": frozenset({"o_orderkey", "o_custkey", "o_totalprice"}),
    "lineitem": frozenset({"l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"}),
    "part": frozenset({"p_partkey", "p_size", "p_retailprice"}),
    "customer": frozenset({"c_custkey", "c_nationkey", "c_acctbal"}),
}
TEMPLATES: dict[str, tuple[str, str, str, dict[str, list[str]]]] = {
    "tmpl_count": ("orders", "how many orders", "count{}", {}),
    "tmpl_count_slots": ("orders", "orders with status {o_orderstatus} and priority {o_orderpriority}", "count{}", {"o_orderstatus": ["F"], "o_orderpriority": ["1-URGENT"]}),
    "tmpl_count_in": ("orders", "priority {o_orderpriority} or {o_orderpriority}", "count{}", {"o_orderpriority": ["1-URGENT", "2-HIGH"]}),
    "tmpl_sum": ("lineitem", "total for flag {l_returnflag}", "sum{l_extendedprice}", {"l_returnflag": ["R"]}),
    "tmpl_sum_none": ("lineitem", "total for flag {l_returnflag}", "sum{l_extendedprice}", {"l_returnflag": ["no such flag"]}),
    "tmpl_avg": ("lineitem", "mean for flag {l_returnflag}", "avg{l_quantity}", {"l_returnflag": ["A"]}),
    "tmpl_count1": ("lineitem", "parts with status {l_linestatus}", "count1{l_partkey}", {"l_linestatus": ["O"]}),
    **{f"tmpl_count1_{n}": ("lineitem", "parts with status {l_linestatus}", f"count1{{l_partkey | l_quantity {op} 40}}", {"l_linestatus": ["O"]}) for n, op in (("gt", ">"), ("lt", "<"), ("ge", ">="), ("le", "<="), ("eq", "=="), ("ne", "!="))},
    "tmpl_listdown_sum": ("orders", "biggest priorities, status {o_orderstatus}", "listdown{o_totalprice}{o_orderpriority}*3", {"o_orderstatus": ["O"]}),
    "tmpl_listup_sum": ("orders", "smallest priorities", "listup{o_totalprice}{o_orderpriority}*2", {}),
    "tmpl_listdown_count": ("part", "commonest types", "listdown{count}{p_type}*10", {}),
    "tmpl_list_multikey": ("customer", "smallest segments", "listup{c_acctbal}{c_mktsegment, c_nationkey}*5", {}),
    "tmpl_list_nolimit": ("part", "all types", "listdown{count}{p_type}**", {}),
    "tmpl_project_distinct": ("part", "brand and type of size {p_size}", "{p_brand}{p_type}", {"p_size": ["7"]}),
    "tmpl_project_wide_comma": ("part", "brand and type of size {p_size}", "{p_brand，p_type}", {"p_size": ["7"]}),
}
for _name, (_table, _question, _answer, _slots) in TEMPLATES.items():
    _tree = template.parse(_question, _answer)
    query(template.to_sql(_tree, _table, _slots, "duckdb", NUMBERS[_table]), _name)(lambda spark, d, t=_tree, n=_table, s=_slots: template.to_dataframe(table(spark, d, n), t, s))


def _blanked(spark, d):
    """orders with blank, null and spaced priorities, and prices that are no numbers."""
    priority = F.expr("CASE o_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN '' ELSE o_orderpriority END")
    price = F.expr("CASE WHEN o_orderpriority = '5-LOW' THEN 'none' WHEN o_orderkey % 3 = 0 THEN NULL ELSE string(cast(o_totalprice AS decimal(18,2))) END")
    return table(spark, d, "orders").select("o_orderkey", priority.alias("priority"), price.alias("price"), F.concat(F.lit(" "), "o_orderstatus", F.lit("\t")).alias("status"))


@query("SELECT o_orderpriority AS priority, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,2))), 2) AS DOUBLE) AS _val FROM orders WHERE o_custkey % 5 > 2 AND o_orderkey % 3 <> 0 AND o_orderpriority <> '5-LOW' AND o_orderstatus = 'F' GROUP BY 1 ORDER BY 2 DESC LIMIT 9")
def tmpl_list_blank_keys(spark, d):
    return template.to_dataframe(_blanked(spark, d), template.parse("status {status}", "listdown{price}{priority}*9"), {"status": ["F "]})


@query("SELECT CAST(sum(o_orderkey::HUGEINT * 1000000000000000) AS DOUBLE) AS result FROM orders")
def tmpl_sum_large(spark, d):
    return template.to_dataframe(table(spark, d, "orders").select((F.col("o_orderkey").cast("decimal(20,0)") * F.lit(10**15).cast("decimal(18,0)")).alias("n")), template.parse("", "sum{n}"))


@query("SELECT r_regionkey, r_name FROM region WHERE r_name = 'ASIA'")
def tmpl_project_all(spark, d):
    return template.to_dataframe(table(spark, d, "region"), template.parse("region {r_name}", "*"), {"r_name": ["ASIA"]})


@query("SELECT value, first, row_number() OVER (ORDER BY first, value)::INTEGER AS rank FROM (SELECT c_mktsegment AS value, min(c_custkey) AS first FROM customer WHERE c_mktsegment IS NOT NULL AND c_mktsegment <> '' GROUP BY 1) ORDER BY first, value LIMIT 3")
def tmpl_first_n_values(spark, d):
    return template.first_values(table(spark, d, "customer"), "c_mktsegment", 3, "c_custkey")


@query("SELECT name, 'MATCH' AS verdict FROM (VALUES ('count'), ('sum'), ('count1'), ('list'), ('project'), ('broken')) AS t(name) WHERE name <> 'broken' UNION ALL SELECT 'broken', 'ERROR'")
def tmpl_dual_check(spark, d):
    lines = table(spark, d, "lineitem")
    cases = {"count": "count{}", "sum": "sum{l_extendedprice}", "count1": "count1{l_partkey | l_quantity > 40}", "list": "listdown{l_extendedprice}{l_linestatus}*2", "project": "{l_returnflag}{l_linestatus}", "broken": "sum{no_such_column}"}
    found = [(n, template.dual_check(lines, template.parse("flag {l_returnflag}", a), {"l_returnflag": ["R"]}).split(":")[0]) for n, a in cases.items()]
    return spark.createDataFrame(found, "name string, verdict string")


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus <> '' AND o_orderpriority <> '' ORDER BY md5(o_orderkey::VARCHAR || '42'), o_orderkey LIMIT 5")
def tmpl_fill_samples(spark, d):
    return template.fill(table(spark, d, "orders"), template.parse("{o_orderstatus} {o_orderpriority}", "count{}"), "o_orderkey", 5)


_DATASET = [("orders of status {o_orderstatus} and priority {o_orderpriority}", "count{}"), ("price of orders with status {o_orderstatus}", "sum{o_totalprice}"), ("best priorities of status {o_orderstatus}", "listdown{count}{o_orderpriority}*2"), ("broken {o_orderstatus}", "sum{no_such_column}")]
_SAMPLED = "SELECT *, row_number() OVER (ORDER BY md5(o_orderkey::VARCHAR || '42'), o_orderkey) AS n FROM orders WHERE o_orderstatus <> '' AND o_orderpriority <> ''"
_PLAIN = "regexp_replace(regexp_replace(CAST({} AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"


@query(
    f"WITH s AS (SELECT * FROM ({_SAMPLED}) WHERE n <= 3) "
    f"SELECT {literal(_DATASET[0][0])} AS question_template, concat('orders of status ', o_orderstatus, ' and priority ', o_orderpriority) AS question, (SELECT count(*) FROM orders o WHERE o.o_orderstatus = s.o_orderstatus AND o.o_orderpriority = s.o_orderpriority)::VARCHAR AS answer, 'MATCH' AS status FROM s WHERE n <= 2 "
    f"UNION ALL SELECT {literal(_DATASET[1][0])}, concat('price of orders with status ', o_orderstatus), (SELECT {_PLAIN.format('round(sum(CAST(o_totalprice AS DECIMAL(38,6))), 2)')} FROM orders o WHERE o.o_orderstatus = s.o_orderstatus), 'MATCH' FROM s "
    f"UNION ALL SELECT {literal(_DATASET[2][0])}, concat('best priorities of status ', o_orderstatus), (SELECT string_agg(concat(p, '|', c), '，' ORDER BY c DESC, p) FROM (SELECT x.o_orderstatus AS t, o_orderpriority AS p, count(*) AS c, row_number() OVER (PARTITION BY x.o_orderstatus ORDER BY count(*) DESC, o_orderpriority) AS r FROM orders x GROUP BY 1, 2) WHERE t = s.o_orderstatus AND r <= 2), 'MATCH' FROM s"
)
def dataset_rows(spark, d):
    """Three samples of each template, of which a former run has one of the first; the broken template gives none."""
    templates = spark.createDataFrame(_DATASET, "question_template string, answer_template string")
    before = spark.createDataFrame([(_DATASET[0][0],)], "question_template string")
    made = generate.dataset(table(spark, d, "orders"), templates, "o_orderkey", 3, before, table="orders")
    return made.rows.select("question_template", "question", "answer", "status")


@query("WITH q AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1) SELECT concat('orders of priority ', p) AS question, n::VARCHAR AS truth, CASE WHEN p = '1-URGENT' THEN NULL ELSE (SELECT count(*) FROM orders)::VARCHAR END AS predicted, p = '1-URGENT' AS failed FROM q WHERE p IN ('1-URGENT', '2-HIGH')")
def eval_error_log(spark, d):
    """The questions that a system gets wrong or fails on: one path counts all orders, another has no answer."""
    orders = table(spark, d, "orders")
    asked = orders.groupBy("o_orderpriority").count().select(F.concat(F.lit("orders of priority "), "o_orderpriority").alias("question"), F.col("count").cast("string").alias("truth"))

    def system(question):
        if question.endswith("1-URGENT"):
            raise ConnectionError("no answer")
        where = "" if question.endswith("2-HIGH") else f" WHERE o_orderpriority = {literal(question.removeprefix('orders of priority '))}"
        sql = f"SELECT count(*) AS n FROM orders{where}"
        return {"final_sql": sql, "execution_result": sqlgate.rows(sqlgate.execute(spark, sql, {"orders": orders})).fetched}

    log = evaluate.run(system, asked)["errors"]
    return spark.createDataFrame([(r["question"], r["truth"], "，".join(r["predicted"]) if "error" not in r else None, "error" in r) for r in log], "question string, truth string, predicted string, failed boolean")


# --- text functions ---------------------------------------------------------------------------------------------------

_HALF = sql_strip(f"regexp_replace(translate(coalesce(text, ''), {literal(X.WIDE)}, {literal(X.NARROW)}), {literal(X.SPACE + '+')}, ' ', 'g')")


@query(f"SELECT doc_id, md5({_HALF}) AS digest FROM documents")
def text_halfwidth(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.half_width(F.col("text"))).alias("digest"))


@query(f"SELECT conv_id, turn, {sql_strip(f'''regexp_replace(coalesce(text, ''), {literal(X.INVISIBLE)}, '', 'g')''')} AS clean FROM conversations")
def text_strip_invisible(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.strip_invisible(F.col("text")).alias("clean"))


_WIDENED = "translate(concat(c_mktsegment, '　', c_name), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ#', 'ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ＃')"


@query(f"SELECT c_custkey, {sql_strip(f'''regexp_replace(translate({_WIDENED}, {literal(X.WIDE)}, {literal(X.NARROW)}), {literal(X.SPACE + '+')}, ' ', 'g')''')} AS narrow FROM customer")
def text_wide_to_narrow(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.half_width(F.expr(_WIDENED)).alias("narrow"))


_NULLS = ", ".join(map(literal, X.NULL_TOKENS))


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN lower({sql_strip('v')}) IN ({_NULLS}) THEN '' ELSE regexp_replace({sql_strip('v')}, '^(\\d+)\\.0$', '\\1') END AS clean FROM (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN ' NaN ' WHEN 1 THEN 'N/A' WHEN 2 THEN l_partkey::VARCHAR || '.0' WHEN 3 THEN '  ' || l_returnflag ELSE l_partkey::VARCHAR || '.50' END AS v FROM lineitem)")
def text_clean_value(spark, d):
    v = F.expr("CASE l_linenumber % 5 WHEN 0 THEN ' NaN ' WHEN 1 THEN 'N/A' WHEN 2 THEN concat(l_partkey, '.0') WHEN 3 THEN concat('  ', l_returnflag) ELSE concat(l_partkey, '.50') END")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.clean_value(v).alias("clean"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN format('{:,}', floor(o_totalprice)::BIGINT) ELSE o_orderpriority END AS raw, CASE WHEN o_orderkey % 2 = 0 THEN floor(o_totalprice)::BIGINT::VARCHAR ELSE o_orderpriority END AS clean FROM orders")
def text_clean_number(spark, d):
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.format_number(F.floor("o_totalprice"), 0)).otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", raw.alias("raw"), X.clean_number_text(raw).alias("clean"))


@query("SELECT p_partkey, regexp_replace(concat('size ', p_size, '.0 key ', p_partkey, '.0, v1.0x'), '(^|[^A-Za-z0-9_.])([0-9]+)\\.0\\b', '\\1\\2', 'g') AS clean FROM part")
def text_drop_dot_zero(spark, d):
    raw = F.concat(F.lit("size "), "p_size", F.lit(".0 key "), "p_partkey", F.lit(".0, v1.0x"))
    return table(spark, d, "part").select("p_partkey", X.drop_dot_zero(raw).alias("clean"))


@query(f"SELECT event_id, regexp_matches({sql_strip('props')}, {literal(X.NUMBER)}) AS props_numeric, regexp_matches(event_id::VARCHAR, {literal(X.NUMBER)}) AS id_numeric FROM events")
def text_numeric_like(spark, d):
    return table(spark, d, "events").select("event_id", X.is_numeric(F.col("props")).alias("props_numeric"), X.is_numeric(F.col("event_id").cast("string")).alias("id_numeric"))


@query("SELECT fmt, count(*) AS n FROM (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'YYYY/MM/DD' WHEN 1 THEN 'YYYY-MM-DD' WHEN 2 THEN '纯数字' ELSE '编码(字母+数字)' END AS fmt FROM orders) GROUP BY fmt")
def text_format_class(spark, d):
    v = F.expr("CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'yyyy/M/d') WHEN 1 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 2 THEN string(o_custkey) ELSE concat('C', o_custkey) END")
    return table(spark, d, "orders").groupBy(X.format_class(v).alias("fmt")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, array_to_string(list_distinct_in_order, ' ') AS codes FROM (SELECT doc_id, list_filter(t, lambda x, i: list_position(t, x) = i) AS list_distinct_in_order FROM (SELECT doc_id, list_filter(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]+$') THEN length(x) >= 6 ELSE regexp_matches(x, '[0-9]') AND length(x) >= 3 END) AS t FROM documents))")
def text_code_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(X.code_tokens(F.col("text")), " ").alias("codes"))


_ASKING = "concat('parts {p_brand} of ', p_name, ' {', p_type, ' | ', p_size, ' > 3}, {', p_brand, '，p_brand}')"


@query(f"SELECT p_partkey, array_to_string(n, '|') AS named, array_to_string(list_sort(list_distinct(list_concat([trim(split_part(n[2], '|', 1)), n[1]], string_split(n[3], '，')))), ',') AS columns FROM (SELECT p_partkey, regexp_extract_all({_ASKING}, '\\{{([^}}]+)\\}}', 1) AS n FROM part)")
def text_placeholders(spark, d):
    question = F.expr(_ASKING)
    return table(spark, d, "part").select("p_partkey", F.array_join(X.placeholders(question), "|").alias("named"), F.array_join(X.placeholder_columns(question), ",").alias("columns"))


@query(f"SELECT p_partkey, upper(regexp_replace(p_name, {literal(X.NOT_WORD)}, '', 'g')) AS form FROM part")
def text_match_form(spark, d):
    return table(spark, d, "part").select("p_partkey", X.match_form(F.col("p_name")).alias("form"))


@query("SELECT p_partkey, concat('brand ', p_brand, ' of type ', p_type) AS filled FROM part")
def text_fill_slots(spark, d):
    asked = X.fill_slots(F.lit("brand {p_brand} of type {p_type}"), {"p_brand": F.col("p_brand"), "p_type": F.col("p_type")})
    return table(spark, d, "part").select("p_partkey", asked.alias("filled"))


@query(f"SELECT conv_id, turn, md5(regexp_replace(text, {literal(X.SPACE + '+')}, '', 'g')) AS digest FROM conversations")
def text_remove_spaces(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(X.remove_spaces(F.col("text"))).alias("digest"))


@query("SELECT c_custkey, concat(c_mktsegment, ',', replace(c_name, ' ', '')) AS entities FROM customer")
def text_entity_filter(spark, d):
    found = F.array(F.concat(F.lit('"'), "c_mktsegment", F.lit(" ，")), F.col("c_name"), F.col("c_mktsegment"), F.lit("c_name"), F.lit("JSON x"), F.lit("absent"), F.lit(" . "))
    kept = X.entity_filter(found, F.concat("c_mktsegment", F.lit(" of c_name JSON x: "), "c_name"), ["c_name"], list(X.PROMPT_ECHOES))
    return table(spark, d, "customer").select("c_custkey", F.array_join(kept, ",").alias("entities"))


@query("SELECT p_partkey, p_size::VARCHAR AS size_text, p_brand AS brand_text, (p_partkey::VARCHAR || '.5') AS half_text FROM part")
def text_cell(spark, d):
    cell = lambda c: X.cell_text(c)
    return table(spark, d, "part").select("p_partkey", cell(F.concat("p_size", F.lit(".00"))).alias("size_text"), cell(F.concat(F.lit(" "), "p_brand", F.lit("\t"))).alias("brand_text"), cell(F.concat("p_partkey", F.lit(".4999"))).alias("half_text"))


@query("SELECT o_orderkey, array_to_string(list_sort(list_distinct([o_orderstatus, o_orderpriority, o_custkey::VARCHAR])), '|') AS items FROM orders")
def text_truth_items(spark, d):
    listed = F.concat("o_orderstatus", F.lit("， "), "o_orderpriority", F.lit(";"), "o_custkey", F.lit(".0；"), "o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", F.array_join(X.truth_items(listed), "|").alias("items"))


@query("SELECT conv_id, turn, concat(conv_id, '|', turn, '|', coalesce(nullif(role, 'system'), ''), '|', md5(coalesce(text, ''))) AS row_text FROM conversations")
def norm_rows_text(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.row_text(F.col("conv_id"), F.col("turn"), F.nullif(F.col("role"), F.lit("system")), F.md5(F.coalesce("text", F.lit("")))).alias("row_text"))


@query("SELECT l_orderkey, l_linenumber, abs(a - b) <= 1e-5 * greatest(abs(a), abs(b)) AS close FROM (SELECT l_orderkey, l_linenumber, l_extendedprice AS a, l_extendedprice * (1 + l_linenumber * 4e-6) AS b FROM lineitem)")
def text_close(spark, d):
    a = F.col("l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.close(a, a * (F.lit(1) + F.col("l_linenumber") * F.lit(4e-6))).alias("close"))


@query("SELECT item_id, text AS line FROM (SELECT item_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM benchmark)")
def text_list_line(spark, d):
    return table(spark, d, "benchmark").select("item_id", X.list_line(F.concat("item_id", F.lit(". **"), X.strip(F.col("text")), F.lit("** "))).alias("line"))


@query("SELECT event_id, props AS encoded FROM (SELECT event_id, '{\"type\":\"' || event_type || '\",\"user\":\"' || user_id::VARCHAR || '\"}' AS props FROM events)")
def text_slot_json(spark, d):
    made = F.to_json(F.create_map(F.lit("type"), "event_type", F.lit("user"), F.col("user_id").cast("string")))
    again = F.to_json(F.from_json(made, "map<string,string>"))
    return table(spark, d, "events").select("event_id", again.alias("encoded"))


@query("SELECT o_orderkey, 'SELECT o_custkey FROM orders WHERE o_orderkey = ' || o_orderkey::VARCHAR AS sql FROM orders")
def sql_extract_from_text(spark, d):
    sql = F.concat(F.lit("SELECT o_custkey FROM orders WHERE o_orderkey = "), "o_orderkey")
    reply = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("<think>SELECT 1</think>```sql\n"), sql, F.lit(";\n```"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Here:\n```\n"), sql, F.lit("\n```\nDone."))).otherwise(F.concat(F.lit("The query is "), sql, F.lit(";")))
    return table(spark, d, "orders").select("o_orderkey", X.extract_sql(reply).alias("sql"))


@query("SELECT p_partkey, concat(p_brand, '|', p_type) AS items FROM part")
def json_array_recover(spark, d):
    n = F.col("p_partkey") % 3
    reply = F.when(n == 0, F.concat(F.lit('Sure: ["'), "p_brand", F.lit('", "'), "p_type", F.lit('",] ok'))).when(n == 1, F.concat(F.lit("['"), "p_brand", F.lit("', ['"), "p_type", F.lit("']]"))).otherwise(F.concat(F.lit('```json\n["'), "p_brand", F.lit('","'), "p_type", F.lit('"]\n```')))
    return table(spark, d, "part").select("p_partkey", F.array_join(arrow.recover_json_array()(reply), "|").alias("items"))


@query("SELECT conv_id, turn, role FROM conversations WHERE (role IS NOT NULL AND role NOT IN ('', 'system')) OR (text IS NOT NULL AND length(text) > 0 AND role <> 'system')")
def drop_blank_rows(spark, d):
    rows = table(spark, d, "conversations").withColumns({"a": F.nullif(F.col("role"), F.lit("system")), "b": F.when(F.col("role") != "system", F.col("text"))})
    return tables.drop_blank_rows(rows, ["a", "b"]).select("conv_id", "turn", "role")


@query("SELECT o_orderkey, status FROM (SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'MATCH' WHEN o_custkey % 3 = 1 THEN 'match' END AS status FROM orders) WHERE status = 'MATCH'")
def filter_matched(spark, d):
    status = F.expr("CASE WHEN o_custkey % 3 = 0 THEN 'MATCH' WHEN o_custkey % 3 = 1 THEN 'match' END")
    return tables.matched(table(spark, d, "orders").select("o_orderkey", status.alias("status")))


# --- profiles ---------------------------------------------------------------------------------------------------------

#: Every scalar column of every table and its kind: integer, text, double or time. Tests hold the list against the tables.
PROFILED = {
    "region": {"r_regionkey": "i", "r_name": "s"},
    "nation": {"n_nationkey": "i", "n_name": "s", "n_regionkey": "i"},
    "customer": {"c_custkey": "i", "c_name": "s", "c_nationkey": "i", "c_acctbal": "d", "c_mktsegment": "s"},
    "supplier": {"s_suppkey": "i", "s_name": "s", "s_nationkey": "i", "s_acctbal": "d"},
    "part": {"p_partkey": "i", "p_name": "s", "p_brand": "s", "p_type": "s", "p_size": "i", "p_retailprice": "d"},
    "orders": {"o_orderkey": "i", "o_custkey": "i", "o_orderstatus": "s", "o_totalprice": "d", "o_orderdate": "t", "o_orderpriority": "s"},
    "lineitem": {"l_orderkey": "i", "l_partkey": "i", "l_suppkey": "i", "l_linenumber": "i", "l_quantity": "d", "l_extendedprice": "d", "l_discount": "d", "l_tax": "d", "l_returnflag": "s", "l_linestatus": "s", "l_shipdate": "t"},
    "events": {"event_id": "i", "ts": "t", "user_id": "i", "event_type": "s", "value": "d", "props": "s"},
    "documents": {"doc_id": "i", "text": "s", "lang": "s", "source": "s", "n_chars": "i"},
    "embeddings": {"vec_id": "i", "label": "i"},
    "pages": {"page_id": "i", "url": "s", "html": "s"},
    "benchmark": {"item_id": "i", "text": "s"},
    "labels": {"doc_id": "i", "quality": "i", "toxic": "i"},
    "conversations": {"conv_id": "i", "turn": "i", "role": "s", "text": "s"},
}


def _sql_text(column: str, kind: str) -> str:
    return {"d": f"CAST({column} AS DECIMAL(38,4))::VARCHAR", "t": f"strftime({column}, '%Y-%m-%d %H:%M:%S')"}.get(kind, f"{column}::VARCHAR")


def _sql_long(name: str, key: str | None = None) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", nullif({sql_strip(_sql_text(c, k))}, '') AS value{f', {key} AS key' if key else ''} FROM {name}" for c, k in PROFILED[name].items())


def _sql_profile(long: str, by: str = '"column"') -> str:
    number = f"CASE WHEN regexp_matches(value, {literal(X.NUMBER)}) THEN TRY_CAST(value AS DOUBLE) END"
    return (
        f"SELECT {by}, total, null_count, null_count / total AS null_ratio, distinct_count, CASE WHEN numeric_ THEN 'NUMERIC' ELSE 'TEXT' END AS data_type, "
        "CASE WHEN numeric_ THEN CAST(round(CAST(low AS DECIMAL(38,6)), 2) AS DOUBLE) END AS min_value, CASE WHEN numeric_ THEN CAST(round(CAST(high AS DECIMAL(38,6)), 2) AS DOUBLE) END AS max_value, distinct_count <= 80 AS is_categorical "
        f"FROM (SELECT *, numbers / greatest(total - null_count, 1) > 0.8 AS numeric_ FROM (SELECT {by}, count(*) AS total, count(*) FILTER (value IS NULL) AS null_count, count(DISTINCT value) AS distinct_count, "
        f"count(*) FILTER (regexp_matches(value, {literal(X.NUMBER)})) AS numbers, min({number}) AS low, max({number}) AS high FROM ({long}) GROUP BY {by}))"
    )


def _profiled(spark, d, name):
    return profile.profile(profile.value_counts(table(spark, d, name)))


for _name in ("orders", "documents", "part", "lineitem", "customer"):
    query(_sql_profile(_sql_long(_name)), f"profile_{_name}")(lambda spark, d, n=_name: _profiled(spark, d, n))


@query(" UNION ALL ".join(f"SELECT '{n}' AS \"table\", * FROM ({_sql_profile(_sql_long(n))})" for n in PROFILED))
def profile_all(spark, d):
    return reduce(DataFrame.unionByName, [_profiled(spark, d, n).select(F.lit(n).alias("table"), "*") for n in PROFILED])


def _sql_top(name: str) -> str:
    return f'SELECT "column", value, count, rank FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value)::INTEGER AS rank FROM (SELECT "column", value, count(*) AS count FROM ({_sql_long(name)}) WHERE value IS NOT NULL GROUP BY 1, 2)) WHERE rank <= 10'


@query(_sql_top("orders"))
def profile_top_values(spark, d):
    return profile.top_values(profile.value_counts(table(spark, d, "orders"), list(PROFILED["orders"])))


_CLASS = " ".join(f"WHEN regexp_matches(value, {literal(p)}) THEN {literal(n)}" for n, p in X.FORMATS)


@query(f"SELECT \"column\", format_pattern FROM (SELECT \"column\", format_pattern, count(*) AS n, sum(count(*)) OVER (PARTITION BY \"column\") AS size FROM (SELECT \"column\", CASE {_CLASS} END AS format_pattern, row_number() OVER (PARTITION BY \"column\" ORDER BY key, value) AS r FROM ({_sql_long('orders', 'o_orderkey')}) WHERE value IS NOT NULL) WHERE r <= 50 GROUP BY 1, 2) WHERE format_pattern IS NOT NULL AND n / size > 0.5")
def profile_format(spark, d):
    return profile.formats(table(spark, d, "orders"), "o_orderkey", list(PROFILED["orders"]))


@query(f"SELECT \"column\", min_value, max_value FROM ({_sql_profile(_sql_long('lineitem'))}) WHERE data_type = 'NUMERIC'")
def profile_numeric_range(spark, d):
    return _profiled(spark, d, "lineitem").filter("data_type = 'NUMERIC'").select("column", "min_value", "max_value")


@query(f"SELECT DISTINCT \"column\", value FROM ({_sql_long('part')}) WHERE value IS NOT NULL AND \"column\" IN (SELECT \"column\" FROM ({_sql_profile(_sql_long('part'))}) WHERE is_categorical)")
def profile_categorical(spark, d):
    return profile.categorical_values(profile.value_counts(table(spark, d, "part"), list(PROFILED["part"])))


@query(f"WITH p AS ({_sql_profile(_sql_long('customer'))}), t AS ({_sql_top('customer')}) SELECT p.\"column\", concat_ws('; ', data_type, CASE WHEN null_ratio > 0.3 THEN concat('nulls ', round(null_ratio * 100)::INTEGER, '%') END, s, CASE WHEN data_type = 'NUMERIC' THEN concat(min_value::DECIMAL(28,2)::VARCHAR, '..', max_value::DECIMAL(28,2)::VARCHAR) END) AS inline FROM p LEFT JOIN (SELECT \"column\", string_agg(substr(value, 1, 25), '/' ORDER BY rank) AS s FROM t WHERE rank <= 6 GROUP BY 1) USING (\"column\")")
def profile_summary(spark, d):
    return profile.summaries(profile.value_counts(table(spark, d, "customer"), list(PROFILED["customer"])))


@query("SELECT p_brand AS value FROM part GROUP BY 1 ORDER BY 1 LIMIT 20")
def profile_distinct_sample(spark, d):
    return tables.distinct_sample(table(spark, d, "part"), "p_brand")


# --- value index ------------------------------------------------------------------------------------------------------

INDEXED = {"customer": ["c_mktsegment", "c_name"], "part": ["p_name", "p_brand", "p_type"], "supplier": ["s_name"], "nation": ["n_name"], "region": ["r_name"]}
_VALUES = " UNION ".join(f"SELECT '{t}.{c}' AS \"column\", {sql_strip(c)} AS value FROM {t} WHERE {c} IS NOT NULL AND {sql_strip(c)} <> ''" for t, columns in INDEXED.items() for c in columns)
WORDS = [" BUILDING ", "Brand#11", "ASIA", "Asia", "no such thing", "x", "FURNITUR", "Brand 11", "AUTOMOBILES"]
_WORDS = ", ".join(f"({literal(w)})" for w in WORDS)


def _values(spark, d):
    return values.column_values({t: (table(spark, d, t), c) for t, c in INDEXED.items()})


def _words(spark):
    return spark.createDataFrame([(w,) for w in WORDS], "keyword string")


@query(f"SELECT value, array_to_string(list_sort(list(\"column\")), ',') AS columns FROM ({_VALUES}) GROUP BY value")
def vindex_exact(spark, d):
    return values.exact_index(_values(spark, d)).select("value", F.array_join("columns", ",").alias("columns"))


@query(f"SELECT keyword, array_to_string(list_sort(list(\"column\")), ',') AS columns FROM (VALUES {_WORDS}) AS w(keyword) JOIN ({_VALUES}) ON value = trim(keyword) GROUP BY keyword")
def vindex_lookup(spark, d):
    return values.lookup(_words(spark), values.exact_index(_values(spark, d))).select("keyword", F.array_join("columns", ",").alias("columns"))




def _form(e: str) -> str:
    return f"upper(regexp_replace({e}, {literal(X.NOT_WORD)}, '', 'g'))"


_MISSES = f"SELECT keyword FROM (VALUES {_WORDS}) AS w(keyword) WHERE length({_form('keyword')}) >= 2 AND trim(keyword) NOT IN (SELECT value FROM ({_VALUES}))"


@query(_MISSES)
def vindex_miss(spark, d):
    return values.misses(_words(spark), values.exact_index(_values(spark, d)))


_NEAR = f"SELECT keyword, \"column\", value, len(list_intersect(k, v)) / len(list_distinct(list_concat(k, v))) AS jaccard FROM (SELECT keyword, list_distinct(string_split({_form('keyword')}, '')) AS k FROM ({_MISSES})), (SELECT \"column\", value, list_distinct(string_split({_form('value')}, '')) AS v FROM ({_VALUES}) WHERE length(value) >= 2 AND {_form('value')} <> '') WHERE len(list_intersect(k, v)) >= 0.75 * len(list_distinct(list_concat(k, v)))"


@query(f"SELECT keyword, \"column\", value, round(jaccard, 6) AS jaccard FROM ({_NEAR})")
def vindex_fuzzy_jaccard(spark, d):
    found = _values(spark, d)
    return values.near(values.misses(_words(spark), values.exact_index(found)), found).select("keyword", "column", "value", F.round("jaccard", 6).alias("jaccard"))


@query()
def vindex_fuzzy_verified(spark, d):
    found = _values(spark, d)
    return values.verified(values.near(values.misses(_words(spark), values.exact_index(found)), found)).withColumn("jaccard", F.round("jaccard", 6))


LITERALS = [("customer.c_mktsegment", "BUILDING"), ("customer.c_mktsegment", "Brand#11"), ("part.p_brand", "Brand#11"), ("nation.n_name", "NOWHERE"), ("region.r_name", "ASIA")]
_PAIRS = ", ".join(f"({literal(c)}, {literal(v)})" for c, v in LITERALS)


@query(f"SELECT p.\"column\", p.value FROM (VALUES {_PAIRS}) AS p(\"column\", value) WHERE EXISTS (SELECT 1 FROM ({_VALUES}) AS v WHERE v.\"column\" = p.\"column\" AND v.value = p.value)")
def literal_in_column(spark, d):
    return values.literals_present(spark.createDataFrame(LITERALS, "column string, value string"), _values(spark, d))


_ASKED = [("o_orderstatus", "nowhere"), ("o_orderstatus", "F"), ("o_orderpriority", "1-URGENT"), ("o_orderpriority", "9-NEVER"), ("o_orderpriority", "2-HIGH")]


@query("SELECT p.\"column\", p.value FROM (VALUES " + ", ".join(f"({literal(c)}, {literal(v)})" for c, v in _ASKED) + ") AS p(\"column\", value) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE (p.\"column\" = 'o_orderstatus' AND o_orderstatus = p.value) OR (p.\"column\" = 'o_orderpriority' AND o_orderpriority = p.value))")
def literal_mismatch(spark, d):
    orders = table(spark, d, "orders")
    pairs = sqlgate.where_literals(spark, "SELECT count(*) FROM orders WHERE (o_orderstatus = 'nowhere' OR 'F' = o_orderstatus) AND o_orderpriority IN ('1-URGENT', '9-NEVER', '2-HIGH') AND o_custkey >= 5 AND o_orderstatus <> 'x'")
    return spark.createDataFrame(sqlgate.missing_literals(orders, pairs), "column string, value string")


# --- linking ----------------------------------------------------------------------------------------------------------

METADATA = [
    ("o_orderkey", "key of the order"), ("o_custkey", "customer who placed the order"), ("o_orderstatus", "status of the order"), ("o_totalprice", "total price"), ("o_orderdate", "date of the order"), ("o_orderpriority", "priority class"),
    ("c_name", "name of the customer"), ("c_nationkey", "nation of the customer"), ("c_acctbal", "account balance"), ("c_mktsegment", "market segment"), ("p_name", "name of the part"), ("p_brand", "brand of the part"), ("p_type", "type of the part"), ("p_size", "size of the part"), ("p_retailprice", "retail price"), ("l_quantity", "quantity shipped"), ("l_discount", "discount granted"), ("l_tax", "tax rate"), ("l_returnflag", "return flag"), ("l_shipdate", "date of shipment"),
]
_META = ", ".join(f"({literal(c)}, {literal(t)})" for c, t in METADATA)
def _sql_ranked(question: str) -> str:
    return f"SELECT question_id, column_name, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, column_name)::INTEGER AS rank FROM (SELECT question_id, column_name, CAST(round(CAST(len(list_intersect(q, c)) / len(list_distinct(list_concat(q, c))) AS DECIMAL(20,10)), 6) AS DOUBLE) AS score FROM (SELECT item_id AS question_id, list_distinct(string_split({_form(f'translate({question}, chr(223), chr(115))')}, '')) AS q FROM benchmark), (SELECT column_name, list_distinct(string_split({_form('description')}, '')) AS c FROM (VALUES {_META}) AS m(column_name, description)))"


_RANKED = _sql_ranked("text")
_REQUIRED = "SELECT item_id AS question_id, 'p_brand' AS column_name FROM benchmark WHERE item_id % 2 = 0 UNION SELECT item_id, 'l_tax' FROM benchmark WHERE item_id % 3 = 0"


def _ranked(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.translate("text", "ß", "s").alias("question"))
    return linking.rank_columns(asked, spark.createDataFrame(METADATA, "column_name string, column_description string"))


def _required(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"))
    return linking.must_have(items.filter("question_id % 2 = 0").withColumn("column_name", F.lit("p_brand")), items.filter("question_id % 3 = 0").withColumn("column_name", F.lit("l_tax")))


@query(f"SELECT question_id, column_name, score, rank FROM ({_RANKED}) WHERE rank <= 6")
def link_rank_topk(spark, d):
    return _ranked(spark, d).filter(F.col("rank") <= linking.K)


@query(_REQUIRED)
def link_must_have(spark, d):
    return _required(spark, d)


def _sql_tiers(ranked: str) -> str:
    return f"WITH r AS ({ranked}), m AS ({_REQUIRED}), t AS (SELECT question_id, 1 AS tier, column_name FROM r WHERE rank <= 6 UNION ALL SELECT question_id, 2, column_name FROM r WHERE rank <= 12 UNION ALL SELECT question_id, 3, column_name FROM r WHERE rank BETWEEN 13 AND 18 UNION ALL SELECT question_id, tier, column_name FROM m, (VALUES (1), (2), (3)) AS n(tier)) SELECT question_id, tier, array_to_string(list_sort(list_distinct(list(column_name))), ',') AS columns FROM t GROUP BY 1, 2"


@query(_sql_tiers(_RANKED))
def link_tiers(spark, d):
    return linking.tiers(_ranked(spark, d), _required(spark, d))


@query("SELECT question_id, string_agg(line, chr(10) ORDER BY line) AS text FROM (SELECT DISTINCT item_id AS question_id, concat(keyword, ': ', c, ' = ', md5(keyword)) AS line FROM (SELECT item_id, unnest(string_split(text, ' ')) AS keyword FROM benchmark), (VALUES ('a'), ('b')) AS t(c) WHERE length(keyword) > 5) GROUP BY 1")
def link_evidence(spark, d):
    words = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.explode(F.split("text", " ")).alias("keyword")).filter(F.length("keyword") > 5)
    return linking.evidence_text(words.select("*", F.explode(F.array(F.lit("b"), F.lit("a"), F.lit("b"))).alias("column_name"), F.md5("keyword").alias("value")))


# --- gate and vote ----------------------------------------------------------------------------------------------------

@query("SELECT o_orderpriority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS total FROM orders WHERE o_orderpriority ILIKE '%urgent%' OR o_orderkey IN (SELECT max(o_orderkey) FROM orders) GROUP BY 1")
def sql_exec_select(spark, d):
    text = "-- totals\nSELECT o_orderpriority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS total FROM orders WHERE o_orderpriority LIKE '%urgent%' OR o_orderkey IN (SELECT max(o_orderkey) FROM orders) GROUP BY 1; DROP TABLE orders"
    found = sqlgate.execute(spark, text, {"orders": table(spark, d, "orders")})
    if found.data is None:
        raise RuntimeError(f"{found.error}: {found.detail}")
    return found.data


GATED = {
    "drop": ("DROP TABLE orders", "REJECTED"), "insert": ("INSERT INTO orders VALUES (1)", "REJECTED"), "set": ("SET a=b", "REJECTED"), "reflect": ("SELECT reflect('java.lang.System', 'exit', 0)", "REJECTED"),
    "path": ("SELECT * FROM parquet.`/tmp/x`", "REJECTED"), "other": ("SELECT * FROM customer", "REJECTED"), "own_alias": ("SELECT * FROM customer AS customer", "REJECTED"), "subquery_alias": ("SELECT * FROM customer, (SELECT 1 AS a) AS customer", "REJECTED"),
    "cte_of_itself": ("WITH customer AS (SELECT * FROM customer) SELECT * FROM customer", "REJECTED"), "cte_elsewhere": ("SELECT * FROM customer, (WITH customer AS (SELECT 1 AS a) SELECT a FROM customer) AS x", "REJECTED"),
    "named_late": ("SELECT * FROM IDENTIFIER('customer')", "REJECTED"), "unlisted_function": ("SELECT uuid()", "REJECTED"), "who": ("SELECT current_user", "REJECTED"), "column": ("SELECT nope FROM orders", "NO_SUCH_COLUMN"), "syntax": ("SELECT ( FROM orders", "SQL_ERROR"),
    "update_time": ("SELECT count(*) AS update_time FROM orders", ""), "cte": ("WITH a AS (SELECT o_custkey FROM orders), b AS (SELECT * FROM a) SELECT count(*) AS n FROM b", ""),
}


@query("SELECT p.name, p.error, CASE WHEN p.name IN ('update_time', 'cte') THEN (SELECT count(*) FROM orders) END AS n FROM (VALUES " + ", ".join(f"({literal(n)}, {literal(e)})" for n, (_, e) in GATED.items()) + ") AS p(name, error)")
def sql_gate(spark, d):
    """Verdicts on statements; those that pass are run. `customer` is a view of the session that isn't handed in."""
    table(spark, d, "customer").createOrReplaceTempView("customer")
    try:
        found = [(n, sqlgate.execute(spark, s, {"orders": table(spark, d, "orders")})) for n, (s, _) in GATED.items()]
        return spark.createDataFrame([(n, o.error, o.data.first()[0] if o.data else None) for n, o in found], "name string, error string, n long")
    finally:
        spark.catalog.dropTempView("customer")


def _ran(name: str, oracle: str, of: str, sql: str) -> None:
    """A query of candidate SQL over one table, through the gate and the dialect."""

    @query(oracle, name)
    def run(spark, d):
        found = sqlgate.execute(spark, sql, {of: table(spark, d, of)})
        if found.data is None:
            raise RuntimeError(f"{found.error}: {found.detail}")
        return found.data


_ran("sqlite_division", "SELECT l_orderkey, l_linenumber, l_partkey // 7 AS whole, l_quantity / 7 AS part, CASE WHEN l_linenumber > 1 THEN l_partkey // (l_linenumber - 1) END AS by_zero, (l_partkey + 1) // 2 // 3 AS nested FROM lineitem", "lineitem", 'SELECT l_orderkey, "l_linenumber", l_partkey / 7 AS whole, l_quantity / 7 AS part, l_partkey / (l_linenumber - 1) AS by_zero, (l_partkey + 1) / 2 / 3 AS nested FROM lineitem')
_ran("sqlite_cast_prefix", "SELECT p_partkey, p_size::BIGINT AS prefix, 0::BIGINT AS none, p_size + 0.5::DOUBLE AS real FROM part", "part", "SELECT p_partkey, CAST(p_size || 'abc' AS INTEGER) AS prefix, CAST(p_type AS INT) AS none, CAST(p_size || '.5 x' AS REAL) AS real FROM part")
_ran("sqlite_text_sum", "SELECT sum(p_size)::DOUBLE AS total, avg(p_size) AS mean, 0.0::DOUBLE AS none FROM part", "part", "SELECT sum(p_size || ' pieces') AS total, avg(p_size || 'x') AS mean, total(p_type) AS none FROM part")
_ran("sqlite_strftime", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + (o_orderdate - date_trunc('month', o_orderdate)), '%Y-%m-%d') AS next_month, strftime(date_trunc('year', o_orderdate) - INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS year_before, dayofweek(o_orderdate)::VARCHAR AS weekday FROM orders", "orders", "SELECT o_orderkey, strftime('%Y-%m', o_orderdate) AS month, date(o_orderdate, '+1 month') AS next_month, datetime(o_orderdate, 'start of year', '-1 day') AS year_before, strftime('%w', o_orderdate) AS weekday FROM orders")
_ran("sqlite_glob", "SELECT p_partkey, p_brand GLOB 'Brand#[1-3]?' AS few, p_type GLOB '*[A-M]' AS ending, p_type ILIKE '%sTeel' AS steel FROM part", "part", "SELECT p_partkey, p_brand GLOB 'Brand#[1-3]?' AS few, p_type GLOB '*[A-M]' AS ending, p_type LIKE '%sTeel' AS steel FROM part")
_ran("sqlite_scalar_max", "SELECT p_partkey, greatest(p_size, 10, p_partkey % 40) AS most, CASE WHEN p_size <> 7 THEN least(p_size, 25) END AS least_, CASE WHEN p_size > 20 THEN 'big' ELSE 'small' END AS kind FROM part", "part", "SELECT p_partkey, MAX(p_size, 10, p_partkey % 40) AS most, MIN(nullif(p_size, 7), 25) AS least_, IIF(p_size > 20, 'big', 'small') AS kind FROM part")
_ran("sqlite_substr_zero", "SELECT p_partkey, substr(p_name, 1, 4) AS zero, substr(p_name, 2, 3) AS two, CASE WHEN p_size % 2 = 0 THEN substr(p_name, 1, 2) ELSE substr(p_name, 1, 3) END AS either FROM part", "part", "SELECT p_partkey, substr(p_name, 0, 5) AS zero, substr(p_name, 2, 3) AS two, substr(p_name, p_size % 2, 3) AS either FROM part")
_ran("sqlite_text_compare", "SELECT count(*) FILTER (o_orderkey::VARCHAR = o_orderstatus) AS never, count(*) FILTER (o_custkey % 7 = 3) AS some FROM orders", "orders", "SELECT count(CASE WHEN o_orderkey = o_orderstatus THEN 1 END) AS never, count(CASE WHEN o_custkey % 7 = '3' THEN 1 END) AS some FROM orders")
_ran("sqlite_group_concat", "SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, '/' ORDER BY o_orderpriority) AS listed FROM orders GROUP BY 1", "orders", "SELECT o_orderstatus, group_concat(o_orderpriority, '/') AS listed FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders ORDER BY o_orderpriority) GROUP BY 1")


_CANDIDATES = "SELECT o_custkey % 50 AS question_id, path, CASE WHEN path = 'Direct_Path' AND o_custkey % 3 = 0 THEN 'x' ELSE o_orderstatus END AS a, CASE WHEN path = 'ICL_Path' AND o_custkey % 50 % 5 = 0 THEN 0 ELSE o_custkey % 7 END AS b FROM orders, (VALUES ('thinking_path'), ('ICL_Path'), ('Direct_Path')) AS p(path)"
_PRINTS = f"SELECT question_id, path, md5(string_agg(r, chr(10) ORDER BY r)) AS fingerprint, count(*) AS n_rows FROM (SELECT DISTINCT question_id, path, concat(a, '|', b) AS r FROM ({_CANDIDATES})) GROUP BY 1, 2"
_VOTED = f"SELECT *, count(*) OVER (PARTITION BY question_id, fingerprint) AS votes FROM ({_PRINTS})"


def _prints(spark, d):
    orders = table(spark, d, "orders")
    paths = F.explode(F.array(*[F.lit(p) for p in ("thinking_path", "ICL_Path", "Direct_Path")])).alias("path")
    rows = orders.select((F.col("o_custkey") % 50).alias("question_id"), paths, "o_custkey", "o_orderstatus")
    a = F.when((F.col("path") == "Direct_Path") & (F.col("o_custkey") % 3 == 0), "x").otherwise(F.col("o_orderstatus"))
    b = F.when((F.col("path") == "ICL_Path") & (F.col("question_id") % 5 == 0), 0).otherwise(F.col("o_custkey") % 7)
    return vote.fingerprints(rows.select("question_id", "path", a.alias("a"), b.alias("b")), ["question_id", "path"], ["a", "b"])


@query(_PRINTS)
def vote_fingerprint(spark, d):
    return _prints(spark, d)


@query(f"SELECT question_id, max(votes) >= 2 AS agreed FROM ({_VOTED}) GROUP BY 1")
def vote_majority(spark, d):
    return vote.majority(_prints(spark, d), ["question_id"])


@query(f"SELECT question_id, path, fingerprint, votes, CASE WHEN groups > 1 THEN 'tie' ELSE 'win' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY CASE path WHEN 'thinking_path' THEN 0 WHEN 'ICL_Path' THEN 1 ELSE 2 END) AS place, count(DISTINCT fingerprint) OVER (PARTITION BY question_id) AS groups FROM (SELECT *, max(votes) OVER (PARTITION BY question_id) AS best FROM ({_VOTED})) WHERE votes = best) WHERE place = 1")
def vote_tie(spark, d):
    return vote.select_best(_prints(spark, d), ["question_id"])


# --- retrieval, sets and scores ---------------------------------------------------------------------------------------

@query("SELECT query_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, item_id)::INTEGER AS rank FROM (SELECT q.vec_id AS query_id, i.vec_id AS item_id, CAST(round(CAST(list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS DECIMAL(20,10)), 4) AS DOUBLE) AS score FROM embeddings q, embeddings i WHERE q.vec_id % 100 = 0)) WHERE rank <= 3")
def cosine_topk(spark, d):
    items = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("item_vector"))
    return retrieve.top_k(items.filter("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.col("item_vector").alias("query_vector")), items)


@query("SELECT doc_id, CASE WHEN r < floor(n * 0.8) THEN 'train' WHEN r < floor(n * 0.9) THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '42'), doc_id) - 1 AS r, count(*) OVER () AS n FROM documents)")
def split_train_val_test(spark, d):
    return dataset.split_ordinal(table(spark, d, "documents").select("doc_id"), "doc_id")


@query()
def negatives_hard_easy(spark, d):
    names = spark.createDataFrame(METADATA, "column_name string, column_description string")
    samples = _ranked(spark, d).filter("rank <= 2").groupBy(F.col("question_id").alias("sample_id")).agg(F.sort_array(F.collect_list("column_name")).alias("targets"))
    return dataset.negatives(samples, names, words=dataset.GENERAL_WORDS, same=False)


@query()
def ranker_samples(spark, d):
    names = spark.createDataFrame(METADATA, "column_name string, column_description string")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("sample_id"), F.col("text").alias("question"), F.lit("{o_orderstatus}").alias("q"), F.lit("listdown{o_totalprice}{o_orderpriority}*3").alias("a"))
    return dataset.ranker_samples(dataset.gold_columns(asked, "q", "a"), names)


@query("SELECT source, count(*) AS total, CAST(sum(CASE WHEN doc_id % 4 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS correct, avg(CASE WHEN doc_id % 4 <> 0 THEN 1 ELSE 0 END) AS accuracy, avg(n_chars / 8.0::DOUBLE) AS mean_total_s, avg(n_chars / 16.0::DOUBLE) AS mean_first_s, CAST(sum(doc_id % 2) AS BIGINT) AS repairs, CASE WHEN sum(doc_id % 2) > 0 THEN 0.5::DOUBLE ELSE 0.0 END AS mean_repair_s FROM documents GROUP BY source")
def eval_accuracy(spark, d):
    odd = F.col("doc_id") % 2
    answers = table(spark, d, "documents").select("source", F.concat("lang", F.lit("，100.0")).alias("truth"), F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("100;"), "lang")).alias("predicted"), (F.col("n_chars") / 8).alias("total_s"), (F.col("n_chars") / 16).alias("first_s"), F.when(odd == 1, F.array(F.lit(0.5))).otherwise(F.array().cast("array<double>")).alias("repair_s"))
    return evaluate.accuracy(answers, ["source"])


def _sql_recall(ranked: str) -> str:
    return f"WITH r AS ({ranked}), g AS (SELECT question_id, list_sort(list(column_name)) AS gold FROM r WHERE rank = question_id % 9 + 1 OR rank = 2 GROUP BY 1), t AS (SELECT question_id, list(column_name) AS top, max(column_name) FILTER (rank = 1) AS first FROM r WHERE rank <= 6 GROUP BY 1) SELECT count(*) AS questions, avg(CASE WHEN len(list_filter(gold, lambda x: NOT list_contains(top, x))) = 0 THEN 1 ELSE 0 END) AS full_recall, avg(CASE WHEN list_contains(gold, first) THEN 1 ELSE 0 END) AS top1_hit FROM g JOIN t USING (question_id)"


def _recall(ranked):
    gold = ranked.filter("rank = question_id % 9 + 1 OR rank = 2").groupBy("question_id").agg(F.sort_array(F.collect_list("column_name")).alias("gold"))
    return evaluate.ranking_recall(ranked, gold, 6)


@query(_sql_recall(_RANKED))
def eval_topk_recall(spark, d):
    return _recall(_ranked(spark, d))


@query("SELECT p_type, 40 - n AS needed FROM (SELECT p_type, count(*) FILTER (p_size < 5) AS n FROM part GROUP BY 1) WHERE n < 40")
def eval_resume_needed(spark, d):
    part = table(spark, d, "part")
    return tables.still_needed(part.select("p_type").distinct(), part.filter("p_size < 5"), "p_type", 40)


@query("SELECT conv_id, string_agg(concat(role, ': ', md5(coalesce(text, ''))), chr(10) ORDER BY turn) AS messages FROM conversations GROUP BY conv_id")
def chat_samples(spark, d):
    made = dataset.chat_samples(table(spark, d, "conversations"), "conv_id", "turn")
    return made.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), F.md5(F.coalesce(m["content"], F.lit(""))))), "\n").alias("messages"))


_SIDES = ("SELECT o_custkey, o_orderstatus FROM orders", "SELECT o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 10 <> 0")


@query(f"SELECT 'left' AS side, count(*) AS n FROM ({_SIDES[0]} EXCEPT ALL {_SIDES[1]}) UNION ALL SELECT 'right', count(*) FROM ({_SIDES[1]} EXCEPT ALL {_SIDES[0]})")
def set_difference(spark, d):
    orders = table(spark, d, "orders")
    moved = (F.col("o_custkey") + F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0)).alias("o_custkey")
    a, b = orders.select("o_custkey", "o_orderstatus"), orders.filter("o_orderkey % 10 <> 0").select(moved, "o_orderstatus")
    side = lambda n, x: x.agg(F.count("*").alias("n")).select(F.lit(n).alias("side"), "n")
    return side("left", a.exceptAll(b)).union(side("right", b.exceptAll(a)))


@query("SELECT count(*) AS unique_rows FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem)")
def unique_row_count(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct().agg(F.count("*").alias("unique_rows"))
