"""Question and answer sets from templates: sample, answer twice, compare, paraphrase, append, with resume and counters."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lakeask.functions.text import cell_text, not_blank, strip
from lakeask.operators.profile import as_text
from lakeask.plans import template
from lakeask.plans.models import Paraphraser, SameWords
from lakeask.sources.tables import still_needed

#: Rows of a set: templates, the filled question and its paraphrase, the answer, its SQL, the check's verdict and the slots.
ROWS = "question_template string, answer_template string, filled_question string, question string, answer string, sql string, status string, valid boolean, slots string"
TARGET = 5


@dataclass
class Made:
    """rows of a set, and how the templates fared."""

    rows: DataFrame
    counters: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("success", "skipped_full", "skipped_no_data", "skipped_sql_fail", "errors", "saved_rows"), 0))


def fill_question(question: str, values: dict[str, list[str]]) -> str:
    """The question with its slots filled one after the other: a repeated slot takes the next value each time."""
    for name, texts in values.items():
        for text in texts:
            question = question.replace("{" + name + "}", text, 1)
    return question


def samples(df: DataFrame, tree: template.Template, key: str, count: int) -> list[dict[str, list[str]]]:
    """Slot values of `count` sampled rows; a slot that a question repeats takes the column's first values instead."""
    many = {f: [r["value"] for r in template.first_values(df, f, n, key).orderBy("rank").collect()] for f, n in tree.fields if n > 1}
    once = template.Template(tree.kind, tuple((f, n) for f, n in tree.fields if n == 1))
    if not once.fields:
        return [many] if all(len(many[f]) == n for f, n in tree.fields) else []
    rows = template.fill(df, once, key, count).collect()
    return [{f: many.get(f) or [r[f].strip()] for f, _ in tree.fields} for r in rows]


def _listed(result: DataFrame, tree: template.Template) -> DataFrame:
    """One row with the answer's text: cells joined by a bar, rows by a wide comma, in the order of the template or of the text."""
    cells = [F.coalesce(cell_text(as_text(result, c)), F.lit("")) for c in result.columns]
    line = F.concat_ws("|", *cells)
    place = [F.lit(0), *cells]
    if tree.kind == "list":
        value = F.col("_val").cast("double")
        place = [-value if tree.descending else value, *[F.col(f"`{g}`") for g in tree.groups]]
    ordered = F.sort_array(F.collect_list(F.struct(*[p.alias(f"p{k}") for k, p in enumerate(place)], line.alias("line"))))
    return result.agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "，").alias("answer"))


def answers(df: DataFrame, tree: template.Template, slots: list[dict[str, list[str]]], table: str) -> list[tuple[str, str, str]]:
    """(answer, SQL, verdict) of each sample: the template as a DataFrame and as SQL text, all samples in one job for each form."""
    spark = df.sparkSession
    numbers = frozenset(f.name for f in df.schema if not isinstance(f.dataType, T.StringType))
    texts = [template.to_sql(tree, table, s, "spark", numbers) for s in slots]
    with template.private_view(df) as view:
        forms = ([template.to_dataframe(df, tree, s) for s in slots], [spark.sql(template.to_sql(tree, view, s, "spark", numbers)) for s in slots])
        direct, stated = ({r["k"]: r["answer"] for r in reduce(DataFrame.unionByName, [_listed(x, tree).withColumn("k", F.lit(k)) for k, x in enumerate(f)]).collect()} for f in forms)
    return [(direct[k] or "", text, template.same_text(direct[k], stated[k])) for k, text in enumerate(texts)]


def dataset(df: DataFrame, templates: DataFrame, key: str, target: int = TARGET, done: DataFrame | None = None, table: str = "t", paraphraser: Paraphraser | None = None) -> Made:
    """Up to `target` checked rows for each template (question_template, answer_template) over df, less what `done` has already.

    Templates are a list that people write, so they are taken one by one; the table's rows stay distributed. A template whose
    samples give no answer counts as skipped_no_data, one whose two forms never agree as skipped_sql_fail; only rows that MATCH are
    kept. What a template breaks is counted under errors and ends that template only.
    """
    spark = df.sparkSession
    filled = templates.filter(not_blank(F.col("question_template")) & not_blank(F.col("answer_template"))).select(strip(F.col("question_template")).alias("question_template"), "answer_template")
    before = done if done is not None else spark.createDataFrame([], "question_template string")
    needed = still_needed(filled, before, "question_template", target).collect()
    made = Made(spark.createDataFrame([], ROWS))
    made.counters["skipped_full"] = filled.count() - len(needed)
    words, rows = paraphraser or SameWords(), []
    for asked, answer, lacking in needed:
        try:
            tree = template.parse(asked, answer)
            used = {r[0] for r in before.filter(F.col("question_template") == asked).select("filled_question").collect()} if "filled_question" in before.columns else set()
            chosen = [x for x in samples(df, tree, key, lacking + len(used)) if fill_question(asked, x) not in used][:lacking]
            found = [x for x in zip(chosen, answers(df, tree, chosen, table), strict=True) if x[1][0]] if chosen else []
            if not found:
                made.counters["skipped_no_data"] += 1
                continue
            right = [x for x in found if x[1][2] == "MATCH"]
            if not right:
                made.counters["skipped_sql_fail"] += 1
                continue
            questions = [fill_question(asked, s) for s, _ in right]
            for (slots, (text, sql, status)), plain, said in zip(right, questions, words.paraphrase(questions), strict=True):
                rows.append((asked, answer, plain, said, text, sql, status, True, json.dumps({n: v[0] if len(v) == 1 else v for n, v in slots.items()}, ensure_ascii=False)))
            made.counters["success"] += 1
        except Exception:  # a template is data: what it breaks is counted
            made.counters["errors"] += 1
    made.counters["saved_rows"] = len(rows)
    made.rows = spark.createDataFrame(rows, ROWS)
    return made


def extend(spark: SparkSession, path: str, df: DataFrame, templates: DataFrame, key: str, mode: str = "resume", **options) -> dict[str, int]:
    """Bring the set at path (Parquet) up to its target: `resume` adds what is lacking, `overwrite` begins anew."""
    if mode not in ("resume", "overwrite"):
        raise ValueError(f"mode is {mode!r}, not resume or overwrite")
    try:
        done = spark.read.schema(ROWS).parquet(path) if mode == "resume" else None
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        done = None
    made = dataset(df, templates, key, done=done, **options)
    made.rows.write.mode("append" if done is not None else "overwrite").parquet(path)
    return made.counters
