"""Scalar text functions: Column in, Column out. Patterns use classes that Java and RE2 read alike."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

# Character classes, width and punctuation maps, null tokens, formats, thresholds.
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
INVISIBLE = r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}\x{fffd}\x{feff}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{e000}-\x{f8ff}\x{f0000}-\x{fffff}\x{100000}-\x{10ffff}]"
WIDE = "　" + "".join(map(chr, range(0xFF01, 0xFF5F))) + "。“”‘’【】、"
NARROW = " " + "".join(map(chr, range(0x21, 0x7F))) + ".\"\"''[],"
WIDE_CLASS = r"[\x{3000}\x{ff01}-\x{ff5e}。“”‘’【】、]"
NULL_TOKENS = ("", "nan", "null", "none", "n/a")
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
FORMATS = (("YYYY/MM/DD", r"^\d{4}/\d{1,2}/\d{1,2}$"), ("YYYY-MM-DD", r"^\d{4}-\d{1,2}-\d{1,2}$"), ("纯数字", r"^\d+$"), ("编码(字母+数字)", r"^[A-Za-z]\d+$"))
PROMPT_ECHOES = ("JSON", "json", "数组", "输出", "示例", "规则", "当前任务", "Few-Shot", "Schema", "schema")
PLACEHOLDER = r"\{([^}]+)\}"
NOT_WORD = r"[^\p{L}\p{M}\p{N}_]"
JACCARD, SEQUENCE, LOW_JACCARD, LOW_SEQUENCE, COVER = 0.75, 0.40, 0.32, 0.26, 0.88


#: Marks a column, in its metadata, whose texts were stripped at ingest.
STRIPPED = "lakeask.stripped"


def plain_strip(text: str) -> str:
    """strip() for one text on the driver."""
    space = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), SPACE)
    return re.sub(f"^{space}+|{space}+$", "", text)


def strip(c: Column) -> Column:
    """Both ends free of Unicode white space (Spark's trim knows the space only)."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def half_width(c: Column) -> Column:
    """Full-width forms and CJK punctuation to ASCII, white space to single spaces; null to the empty text."""
    c = F.coalesce(c, F.lit(""))
    narrow = F.when(c.rlike(WIDE_CLASS), F.translate(c, WIDE, NARROW)).otherwise(c)  # translate is dear, and most texts have none
    return strip(F.regexp_replace(narrow, f"{SPACE}+", " "))


def strip_invisible(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), INVISIBLE, ""))


def normalise(c: Column) -> Column:
    """Ingest form of a text: half-width first, then without invisible characters."""
    return strip_invisible(half_width(c))


def not_blank(c: Column) -> Column:
    return c.isNotNull() & (strip(c) != "")


def clean_value(c: Column) -> Column:
    """Null tokens to the empty text; integers written with .0 without it."""
    s = strip(F.coalesce(c, F.lit("")))
    return F.when(F.lower(s).isin(*NULL_TOKENS), "").otherwise(F.regexp_replace(s, r"^(\d+)\.0$", "$1"))


def clean_number_text(c: Column) -> Column:
    """clean_value, and thousands commas removed where the rest is a number."""
    s = clean_value(c)
    bare = F.regexp_replace(s, ",", "")
    return F.regexp_replace(F.when(bare.rlike(NUMBER), bare).otherwise(s), r"^(\d+)\.0$", "$1")


def drop_dot_zero(c: Column) -> Column:
    """Embedded integers written with .0 without it; a number right after a letter or digit is left alone."""
    return F.regexp_replace(c, r"(?<![\p{L}\p{N}_.])(\d+)\.0(?![\p{L}\p{N}_])", "$1")


def is_numeric(c: Column) -> Column:
    return F.coalesce(strip(c).rlike(NUMBER), F.lit(False))


def number(c: Column) -> Column:
    """The text as a double, or null; digits with suffixes such as 1d are no numbers."""
    return F.when(is_numeric(c), strip(c).try_cast("double"))


def format_class(c: Column) -> Column:
    """Name of the first format that a value has, else null."""
    s = strip(c)
    return reduce(lambda rest, f: F.when(s.rlike(f[1]), f[0]).otherwise(rest), reversed(FORMATS), F.lit(None).cast("string"))


def match_form(c: Column) -> Column:
    """Upper case without anything but letters, digits, marks and underscores."""
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), NOT_WORD, ""))


def characters(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two character arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def coverage(query: Column, value: Column) -> Column:
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, value)) / F.size(query)).otherwise(F.lit(0.0))


def fuzzy_verified(query: Column, value: Column, jac: Column, seq: Column, cover: Column) -> Column:
    """Second check of a fuzzy hit; seq is the dearest part and comes last."""
    return (query == value) | ((F.length(query) >= 2) & (cover >= COVER)) | (seq >= SEQUENCE) | ((jac >= LOW_JACCARD) & (seq >= LOW_SEQUENCE))


def placeholders(c: Column) -> Column:
    """Names in braces, in order and with repeats."""
    return F.regexp_extract_all(c, F.lit(PLACEHOLDER), F.lit(1))


def placeholder_columns(c: Column) -> Column:
    """Distinct columns named in braces: parts between commas, without conditions after a bar."""
    parts = F.flatten(F.transform(placeholders(c), lambda x: F.split(F.substring_index(x, "|", 1), "[,，]")))
    return F.sort_array(F.array_distinct(F.filter(F.transform(parts, strip), lambda x: x != "")))


def fill_slots(template: Column, slots: dict[str, str | Column]) -> Column:
    """Slots filled with fixed texts or with each row's own; a null leaves its slot empty. Braces in a text are not filled again."""
    pieces = F.split(template, r"(?=\{)|(?<=\})")
    value = lambda v: F.coalesce(v if isinstance(v, Column) else F.lit(v), F.lit(""))
    filled = lambda p: reduce(lambda rest, s: F.when(p == "{" + s[0] + "}", value(s[1])).otherwise(rest), slots.items(), p)
    return F.array_join(F.transform(pieces, filled), "")


def remove_spaces(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+", "")


def code_tokens(c: Column) -> Column:
    """Distinct code-like runs: six digits or more, or three characters or more with a digit among letters."""
    digits, with_digit = r"^[0-9]+$", r"[0-9]"
    runs = F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(runs, lambda x: F.when(x.rlike(digits), F.length(x) >= 6).otherwise(x.rlike(with_digit) & (F.length(x) >= 3))))


def entity_filter(values: Column, question: Column, columns: list[str], echoes: list[str]) -> Column:
    """Entities trimmed of quotes and punctuation, at most 80 characters, found in the question, no column name, no echo of the
    prompt, once each."""
    edge = r"[,.;:'\"`，。；：“”‘’、\x09-\x0d\x20\x{3000}]"
    asked = remove_spaces(question)
    trimmed = F.transform(values, lambda v: F.regexp_replace(v, f"^{edge}+|{edge}+$", ""))
    short = F.filter(trimmed, lambda v: (F.length(v) > 0) & (F.length(v) <= 80))
    bare = F.transform(short, remove_spaces)
    echo = lambda v: reduce(lambda a, e: a | v.contains(e), echoes, F.lit(False))
    return F.array_distinct(F.filter(bare, lambda v: asked.contains(v) & ~v.isin(*columns) & ~echo(v) if columns else asked.contains(v) & ~echo(v)))


def cell_text(c: Column) -> Column:
    """A cell in canonical text: numbers rounded to two places without trailing zeros, other texts stripped."""
    value = F.round(number(c).cast("decimal(28,6)"), 2)
    plain = F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.coalesce(plain, strip(F.coalesce(c, F.lit(""))))


def truth_items(c: Column) -> Column:
    """Distinct answers of a list written with commas or semicolons of either width, sorted."""
    return F.sort_array(F.array_distinct(F.filter(F.transform(F.split(c, "[,，;；]"), cell_text), lambda x: x != "")))


def row_text(*columns: Column) -> Column:
    """Cells joined by a bar; null cells are empty, not skipped."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])


def close(a: Column, b: Column, tolerance: float = 1e-5) -> Column:
    return F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))


def list_line(c: Column) -> Column:
    """A line of a listed answer without its number and bold marks."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"^\s*\d+[.)、]\s*", ""), r"\*\*", ""))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null for zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def extract_sql(c: Column) -> Column:
    """SQL of a model's reply: thoughts dropped; a fenced sql block, any fenced block, or the text from the first SELECT."""
    said = F.regexp_replace(c, r"(?is)<think>.*?</think>", "")
    fenced, any_fence, bare = (F.regexp_extract(said, p, 1) for p in (r"(?is)```sql\s*(.*?)```", r"(?is)```\s*(.*?)```", r"(?is)(\bselect\b.*)"))
    chosen = F.when(strip(fenced) != "", fenced).when(strip(any_fence) != "", any_fence).otherwise(bare)
    return F.regexp_replace(strip(chosen), r"[;\s]+$", "")
