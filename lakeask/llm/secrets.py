"""Secret scans with multipart credential linking, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import stage

# The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
# Parts that are secrets only in company.
IDENT = r"""(?i)(client_?id|access_?key_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=@-]+)"""
ENDPOINT = r"""(https?|postgres|mysql|mongodb|amqp|redis|ftp)://([^\x00-\x20"'<>]+)"""
WEAK = r"(?<![A-Za-z0-9+/_-])(?=[a-zA-Z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}"

KINDS = ("assign", "access", "hex", "ident", "endpoint", "weak")
#: Most code points between the end of one part of a credential and the start of the next.
SCOPE = 400


#: Pattern, group whose length counts, least length, and the signs without one of which no match can be (None: any text may have one).
PATTERNS = (
    (ASSIGN, 2, 6, ("=", ":")), (ACCESS, 0, 20, ("AKIA",)), (HEX, 0, 24, None), (IDENT, 2, 3, ("=", ":")), (ENDPOINT, 2, 3, ("://",)), (WEAK, 0, 20, ("=", ":", "AKIA")),
)
_HITS = "array<struct<kind:int,number:int,gap:int,size:int,ok:boolean>>"


def _matches(text: Column, kind: int) -> Column:
    """Does a pattern match? It runs only where a sign of it is found, once over the text."""
    pattern, _, _, signs = PATTERNS[kind]
    found = text.rlike(pattern)
    return found if signs is None else reduce(lambda a, b: a | b, [text.contains(x) for x in signs]) & found


def _hits(text: Column, kind: int) -> Column:
    """Matches of a pattern in order: kind, number, length of the text before (from the last match), own length, whether it counts.
    The group is read from the match alone: the pattern begins there and has no look-around where a group counts."""
    pattern, group, least, _ = PATTERNS[kind]
    value = (lambda m: F.regexp_extract(m, pattern, group)) if group else (lambda m: m)
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern).alias("g"))
    found = F.transform(F.filter(zipped, lambda z: z["m"].isNotNull()), lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("number"), F.length(z["g"]).alias("gap"), F.length(z["m"]).alias("size"), (F.length(value(z["m"])) >= least).alias("ok")))
    return F.when(_matches(text, kind), found).otherwise(F.expr("array()").cast(_HITS))


def _located(hit_rows: DataFrame) -> DataFrame:
    """(rid, kind, start, end, ok) in code points, from the lengths of matches and of the text between them."""
    each = hit_rows.select("rid", F.explode("hits").alias("h")).select("rid", "h.*")
    run = W.partitionBy("rid", "kind").orderBy("number").rowsBetween(W.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(run))
    return each.select("rid", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "ok").filter("ok")


def _linked(spans: DataFrame) -> DataFrame:
    """Weak parts that an interval join finds complementary parts of within a scope.

    Identifiers need a secret (assign, hex or weak); weak secrets need an identifier (access or ident) or an endpoint.
    Parts meet by an equi-join on row and scope, semi, so that no pair is ever emitted: a weak part stands in the scopes of its
    start and end and their neighbours, another in those of its start and end, and the end of the first of two parts that are near
    is in the same scope as the start of the next or in one beside it. So a part has six rows at most, however long it is.
    """
    scope = lambda at: F.floor(F.col(at) / SCOPE)
    around = lambda at: [scope(at) + k for k in (-1, 0, 1)]
    out = None
    for kind, others in ((5, (1, 3, 4)), (3, (0, 2, 5))):
        weak = spans.filter(F.col("kind") == kind).withColumn("scope", F.explode(F.array_distinct(F.array(*around("start"), *around("end")))))
        other = spans.filter(F.col("kind").isin(*others)).select(F.col("rid").alias("orid"), F.explode(F.array_distinct(F.array(scope("start"), scope("end")))).alias("oscope"), F.col("start").alias("ostart"), F.col("end").alias("oend"))
        near = (F.col("rid") == F.col("orid")) & (F.col("scope") == F.col("oscope")) & ((F.col("ostart") - F.col("end")).between(0, SCOPE) | (F.col("start") - F.col("oend")).between(0, SCOPE))
        found = weak.join(other, near, "left_semi").select("rid", "kind", "start", "end").distinct()
        out = found if out is None else out.union(found)
    return out


def scan_secrets(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row of docs (columns `keep`, default all, as struct `row`) with `spans`: array of (start, kind, end).

    Kinds number KINDS; starts and ends count code points, end exclusive; spans are sorted by start, then kind. assign,
    access and hex are the base findings; ident and weak are parts reported only when at most SCOPE code points
    lie between them and complementary parts; endpoints serve as company only. Null and empty texts have none. Rows without any match never
    shuffle, and patterns look for a first match in them only; rows with one are written once with a row number, so repeated rows and ids are told apart.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(*(keep or ["*"])).alias("row")
    empty = F.expr("array()").cast("array<struct<start:bigint,kind:int,end:bigint>>")
    any_match = reduce(lambda a, b: a | b, [_matches(text, k) for k in range(len(PATTERNS))])
    clean = docs.filter(~any_match).select(row, empty.alias("spans"))
    hits = F.flatten(F.array(*[_hits(text, k) for k in range(len(PATTERNS))]))
    dirty = stage(docs.filter(any_match).select(row, hits.alias("hits"), F.monotonically_increasing_id().alias("rid")), "hits")
    spans = stage(_located(dirty), "spans")
    found = spans.filter("kind < 3").select("rid", "kind", "start", "end").union(_linked(spans))
    listed = found.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    return clean.union(dirty.join(listed, "rid", "left").select("row", F.coalesce("spans", empty).alias("spans")))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, marker: str = "[SECRET]") -> Column:
    """The text with every stretch that spans cover replaced by the marker; overlapping spans become one."""
    none = F.expr("array()").cast("array<struct<start:bigint,end:bigint>>")
    empty = F.struct(none.alias("done"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))

    def closed(a: Column) -> Column:
        return F.when(a["end"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(F.struct(a["start"].alias("start"), a["end"].alias("end")))))

    def add(a: Column, s: Column) -> Column:  # spans come by start: one either reaches into the open stretch or closes it
        longer = F.struct(a["done"].alias("done"), a["start"].alias("start"), F.greatest(a["end"], s["end"]).alias("end"))
        return F.when(s["start"] <= a["end"], longer).otherwise(F.struct(closed(a).alias("done"), s["start"].alias("start"), s["end"].alias("end")))

    merged = F.aggregate(spans, empty, add, closed)
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(merged, lambda s: s["end"]))
    starts = F.concat(F.transform(merged, lambda s: s["start"]), F.array(F.length(text).cast("long")))
    pieces = F.zip_with(ends, starts, lambda e, s: F.substring(text, (e + 1).cast("int"), (s - e).cast("int")))
    return F.when(F.size(spans) > 0, F.array_join(pieces, marker)).otherwise(text)
