"""Question to answer: link, generate, gate, execute, check, repair, vote; and the single-shot baseline."""

from __future__ import annotations

import re
import time
from concurrent.futures import ThreadPoolExecutor, as_completed
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal, localcontext

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeask.operators import linking, profile, values
from lakeask.plans import sqlgate
from lakeask.plans.models import PATHS, CodeEntities, EntityExtractor, Generator, LooseMatch, Repairer, Tokens
from lakeask.sources import tables

REPAIRS = 2
#: Paths whose agreement ends the wait for the slow one.
FAST_PATHS = ("ICL_Path", "Direct_Path")


def plain_text(question: str) -> str:
    """normalise() for one text on the driver, by the same tables."""
    from lakeask.functions.text import INVISIBLE, NARROW, SPACE, WIDE

    python = lambda p: re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), p)
    text = question.translate(str.maketrans(WIDE, NARROW))
    return re.sub(python(INVISIBLE), "", re.sub(python(SPACE) + "+", " ", text)).strip()


def plain_cell(c: object) -> str:
    """sqlgate.plain_cell for one value on the driver."""
    if c is None or isinstance(c, str):
        return (c or "").strip()
    if isinstance(c, bool) or not isinstance(c, (int, float, Decimal)) or not Decimal(str(c)).is_finite():
        return str(c).strip()
    with localcontext() as context:
        context.prec = 400
        text = f"{Decimal(str(c)).quantize(Decimal('0.01'), ROUND_HALF_UP):f}".rstrip("0").rstrip(".")
    return "0" if text == "-0" else text


@dataclass
class Candidate:
    """SQL and its result. `rows` are the distinct rows to show, `whole` the figures of all rows; without it, rows are all."""

    path: str
    sql: str
    status: str = "new"
    rows: list[tuple] = field(default_factory=list)
    error: str = ""
    repair_times: list[float] = field(default_factory=list)
    whole: sqlgate.Whole | None = None

    @property
    def votable(self) -> bool:
        return self.status == "success" and (self.whole.full_rows > 0 if self.whole else any(map(has_text, self.rows)))

    @property
    def fingerprint(self) -> tuple:
        return self.whole.fingerprint if self.whole else tuple(sorted({tuple(map(plain_cell, r)) for r in self.rows}))

    def answer(self, blanks: bool) -> dict:
        """Rows to show and the number of all distinct ones, with or without rows of blank cells. If the rows shown are not all,
        `cut` is there and true, and `result` is the whole result, lazy."""
        rows = sorted({r for r in self.rows if blanks or has_text(r)}, key=str)
        count = (self.whole.rows if blanks else self.whole.full_rows) if self.whole else len(rows)
        return {"execution_result": rows, "unique_rows_count": count, **({"cut": True, "result": self.whole.data} if count > len(rows) else {})}


def has_text(row: tuple) -> bool:
    return any(c is not None and str(c).strip() for c in row)


def agreed(candidates: list[Candidate]) -> bool:
    prints = [c.fingerprint for c in candidates if c.votable]
    return len(prints) > len(set(prints))


def choose(candidates: list[Candidate]) -> tuple[Candidate | None, str]:
    """The largest group's candidate, thinking before ICL before direct; `tie` if two groups are equally large."""
    order = lambda c: next((k for k, n in enumerate(("thinking", "icl", "direct")) if n in c.path.lower()), 3)
    groups: dict[tuple, list[Candidate]] = {}
    for c in candidates:
        if c.votable:
            groups.setdefault(c.fingerprint, []).append(c)
    if not groups:
        return (candidates[0], "no_data") if candidates else (None, "all_paths_failed")
    most = max(map(len, groups.values()))
    leaders = [c for g in groups.values() if len(g) == most for c in g]
    return min(leaders, key=order), "tie" if sum(len(g) == most for g in groups.values()) > 1 else "win"


@dataclass
class Engine:
    """One table to ask. metadata: column_name, column_description; examples: pairs of question and SQL. With `cache`, a folder, the
    value index is kept there with the `stamp` of what it was made from. Generators count their tokens in `tokens`, if given it."""

    spark: SparkSession
    table: DataFrame
    name: str
    metadata: DataFrame
    generator: Generator
    repairer: Repairer = field(default_factory=LooseMatch)
    entities: EntityExtractor = field(default_factory=CodeEntities)
    examples: list[tuple[str, str]] = field(default_factory=list)
    k: int = linking.K
    tokens: Tokens = field(default_factory=Tokens)
    cache: str | None = None
    stamp: dict[str, str] = field(default_factory=dict)
    failures: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        names = [f.name for f in self.table.schema]
        saved = tables.load_index(self.spark, self.cache, **self.stamp) if self.cache else None
        if saved is None:
            saved = values.column_values({self.name: (self.table, names)})
            if self.cache:  # the next start with the same stamp - version, file time, model - reads it
                tables.save_index(saved, self.cache, **self.stamp)
                saved = tables.load_index(self.spark, self.cache, **self.stamp)
        self.values = saved.cache()
        self.index = values.exact_index(self.values)
        self.inline = profile.summaries(profile.value_counts(self.table, names)).cache()
        self.width = self.metadata.count()

    def link(self, question: str, keywords: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Ranked columns, must-have columns, and evidence rows."""
        asked = self.spark.createDataFrame([(1, question)], "question_id int, question string")
        ranked = linking.rank_columns(asked, self.metadata).cache()
        words = self.spark.createDataFrame([(k,) for k in keywords], "keyword string")
        bare = lambda c: F.substring_index(c, ".", -1)
        held = values.lookup(words, self.index).select("keyword", F.explode("columns").alias("column"))
        exact = held.select(F.lit(1).alias("question_id"), "keyword", bare("column").alias("column_name"), F.col("keyword").alias("value"))
        top = ranked.filter(F.col("rank") <= self.k).select(F.concat(F.lit(f"{self.name}."), "column_name").alias("column"))
        near = values.verified(values.near(values.misses(words, self.index), self.values.join(F.broadcast(top), "column", "left_semi")))
        fuzzy = near.select(F.lit(1).alias("question_id"), "keyword", bare("column").alias("column_name"), "value")
        return ranked, linking.must_have(exact, fuzzy), exact.unionByName(fuzzy)

    def try_sql(self, path: str, sql: str) -> Candidate:
        found = sqlgate.whole(sqlgate.execute(self.spark, sql, {self.name: self.table}))
        return Candidate(path, sql, "success" if found.ok else "failed", found.fetched or [], f"{found.error}: {found.detail}" if found.error else "", whole=found.whole)

    def refine(self, question: str, candidate: Candidate, schema: str) -> Candidate:
        """Up to two repairs of an error, or of a literal that its column lacks in a result with rows."""
        for round_ in range(1, REPAIRS + 1):
            problem = candidate.error
            if candidate.status == "success":
                lost = sqlgate.missing_literals(self.table, sqlgate.where_literals(self.spark, candidate.sql)) if candidate.rows else []
                if not lost:
                    break
                problem = "; ".join(f"{c} never is {v!r}" for c, v in lost)
            began = time.time()
            fixed = self.try_sql(f"{candidate.path.split('_Refined')[0]}_Refined_{round_}", self.repairer.repair(question, candidate.sql, problem, schema))
            fixed.repair_times = [*candidate.repair_times, time.time() - began]
            candidate = fixed
        return candidate

    def candidates(self, question: str, schema: str, evidence: str, early_stop: bool = True) -> list[Candidate]:
        """Three paths at once, each with its temperature. When the two fast ones have run and agree, the thinking one isn't waited
        for; a path that fails or says nothing is left out, and why is kept in `failures`."""
        done: list[Candidate] = []
        self.failures = {}
        pool = ThreadPoolExecutor(len(PATHS))
        try:
            waiting = {pool.submit(self.generator.generate, p, question, schema, evidence, self.examples if "ICL" in p else [], t): p for p, t in PATHS.items()}
            for future in as_completed(waiting):
                path = waiting[future]
                try:
                    sql = extract(future.result())
                except Exception as error:  # one model call of three
                    self.failures[path] = f"{type(error).__name__}: {error}"
                    continue
                if sql:
                    done.append(self.try_sql(path, sql))
                if early_stop and agreed([c for c in done if c.path in FAST_PATHS]):
                    break
        finally:
            pool.shutdown(wait=False, cancel_futures=True)
        done.sort(key=lambda c: list(PATHS).index(c.path))
        return done if agreed(done) else [self.refine(question, c, schema) for c in done]

    def ask(self, question: str) -> dict:
        """The answer and how it came about; tiers of columns widen until a candidate succeeds."""
        began = time.time()
        question = plain_text(question)
        slim = [r["column_name"] for r in linking.rank_columns(self.spark.createDataFrame([(1, question)], "question_id int, question string"), self.metadata).filter(F.col("rank") <= self.k).orderBy("rank").collect()]
        keywords = self.entities.extract(question, linking.schema_prompt(self.metadata, slim, self.inline, "db", self.name))
        ranked, required, evidence = self.link(question, keywords)
        said = "\n".join(r["text"] for r in linking.evidence_text(evidence).collect())
        first, best, reason = None, None, "all_paths_failed"
        for number in (1, 2, 3):
            columns = [r["column_name"] for r in linking.tier(ranked, required, number, self.k).orderBy(F.col("rank").asc_nulls_last(), "column_name").collect()]
            if number > 1 and not columns:
                break
            found = self.candidates(question, linking.schema_prompt(self.metadata, columns, self.inline, "db", self.name), said)
            first = first or time.time() - began
            best, reason = choose(found)
            if best is not None and best.status == "success":
                break
        answer = best.answer(blanks=False) if best else {"execution_result": [], "unique_rows_count": 0}
        return {"final_sql": best.sql if best else "", **answer, "reason": reason, "first_inference_time": first, "repair_times": best.repair_times if best else [], "cost_time": time.time() - began, "token_usage": self.tokens.report()}

    def baseline(self, question: str, pruned: bool = False) -> dict:
        """One generation over the full schema or the first tier; no repair, no vote."""
        began = time.time()
        question = plain_text(question)
        names = [r["column_name"] for r in self.metadata.select("column_name").collect()]
        if pruned:
            ranked, required, _ = self.link(question, self.entities.extract(question, ""))
            names = [r["column_name"] for r in linking.tier(ranked, required, 1, self.k).collect()]
        sql = extract(self.generator.generate("Direct_Path", question, linking.schema_prompt(self.metadata, names, None, "db", self.name), "", [], PATHS["Direct_Path"]))
        found = self.try_sql("Direct_Path", sql) if sql else Candidate("Direct_Path", "", "failed")
        return {"final_sql": found.sql, **found.answer(blanks=True), "reason": "baseline", "first_inference_time": time.time() - began, "repair_times": [], "cost_time": time.time() - began, "token_usage": self.tokens.report()}


def extract(reply: str) -> str:
    """SQL of a reply on the driver: the rules of functions.text.extract_sql."""
    reply = re.sub(r"(?is)<think>.*?</think>", "", reply or "")
    for pattern in (r"(?is)```sql\s*(.*?)```", r"(?is)```\s*(.*?)```", r"(?is)(\b(?:with|select)\b.*)"):
        if (m := re.search(pattern, reply)) and m[1].strip():
            return m[1].strip().rstrip("; \n\t")
    return ""


__all__ = ["Candidate", "Engine", "agreed", "choose", "extract", "plain_text"]
