"""What candidate SQL is written in - SQLite's SELECT - turned into Spark's: by tokens here, by types in sqlgate.typed_edits()."""

from __future__ import annotations

import re
from collections.abc import Callable

_QUOTED = r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`"
# Parts of strftime, units of date modifiers, names of number types.
DATE_PARTS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "f": "ss.SSS"}
UNITS = {"day": "make_dt_interval({n})", "hour": "make_dt_interval(0, {n})", "minute": "make_dt_interval(0, 0, {n})", "second": "make_dt_interval(0, 0, 0, {n})"}
WHOLE, REAL = ("int", "integer", "bigint", "smallint", "tinyint"), ("real", "double", "float", "numeric")


def quote_mask(sql: str) -> str:
    """The text with everything inside of quotes blanked, of the same length."""
    return re.sub(_QUOTED, lambda m: m[0][0] + "\0" * (len(m[0]) - 2) + m[0][-1], sql)


def _closing(mask: str, opening: int) -> int:
    depth = 0
    for k in range(opening, len(mask)):
        depth += (mask[k] == "(") - (mask[k] == ")")
        if depth == 0:
            return k
    return -1


def arguments(text: str) -> list[str]:
    """Arguments between the parentheses of a call, split at commas outside of quotes and parentheses."""
    mask, depth, at, out = quote_mask(text), 0, 0, []
    for k, sign in enumerate(mask):
        depth += (sign == "(") - (sign == ")")
        if sign == "," and depth == 0:
            out.append(text[at:k].strip())
            at = k + 1
    return [*out, text[at:].strip()]


def number_text(e: str) -> str:
    """The number a text begins with, 0 without one, null for null."""
    found = f"regexp_extract(CAST({e} AS STRING), '^\\\\s*([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?)', 1)"
    return f"IF(({e}) IS NULL, NULL, COALESCE(TRY_CAST(NULLIF({found}, '') AS DOUBLE), 0.0D))"


def _cast(inner: str) -> str | None:
    m = re.search(r"(?i)\s+as\s+([a-z]+)\s*(?:\([^()]*\))?\s*$", quote_mask(inner))
    if not m or m[1].lower() not in (*WHOLE, *REAL, "text"):
        return None
    e = inner[: m.start()].strip()
    if m[1].lower() == "text":
        return f"CAST({e} AS STRING)"
    if m[1].lower() in REAL:
        return number_text(e)
    whole = f"TRY_CAST(NULLIF(regexp_extract(CAST({e} AS STRING), '^\\\\s*([+-]?[0-9]+)', 1), '') AS BIGINT)"
    return f"IF(({e}) IS NULL, NULL, COALESCE({whole}, 0))"


def _moment(args: list[str]) -> str | None:
    """A time value and its modifiers as a timestamp, or None if a modifier isn't known."""
    t = "CURRENT_TIMESTAMP()" if not args or args[0].lower() == "'now'" else f"TRY_CAST({args[0]} AS TIMESTAMP)"
    for text in args[1:]:
        plain = text.strip("'").strip().lower()
        if m := re.fullmatch(r"([+-]?\d+)\s+(month|year)s?", plain):  # the day goes over into the next month, as SQLite has it
            months = int(m[1]) * (12 if m[2] == "year" else 1)
            t = f"(date_trunc('MONTH', {t}) + make_ym_interval(0, {months}) + ({t} - date_trunc('MONTH', {t})))"
        elif m := re.fullmatch(r"([+-]?\d+)\s+(day|hour|minute|second)s?", plain):
            t = f"({t} + {UNITS[m[2]].format(n=int(m[1]))})"
        elif m := re.fullmatch(r"start of (day|month|year)", plain):
            t = f"date_trunc('{m[1].upper()}', {t})"
        elif plain not in ("utc", "localtime"):
            return None
    return t


def _strftime(args: list[str]) -> str | None:
    if not re.fullmatch(r"'(?:[^'])*'", args[0]) or (t := _moment(args[1:])) is None:
        return None
    parts = []
    for text in re.findall(r"%.|[^%]+", args[0][1:-1]):
        if text[0] != "%" or text == "%%":
            parts.append("'" + text.replace("%%", "%").replace("\\", "\\\\") + "'")
        elif text[1] in DATE_PARTS:
            parts.append(f"date_format({t}, '{DATE_PARTS[text[1]]}')")
        elif text[1] in "ws":
            parts.append(f"CAST({f'dayofweek({t}) - 1' if text[1] == 'w' else f'unix_timestamp({t})'} AS STRING)")
        else:
            return None
    return f"CONCAT({', '.join(parts)})"


def _dated(pattern: str) -> Callable[[list[str]], str | None]:
    return lambda args: (t := _moment(args)) and f"date_format({t}, '{pattern}')"


def _extreme(name: str) -> Callable[[list[str]], str | None]:
    return lambda args: f"IF({' OR '.join(f'({a}) IS NULL' for a in args)}, NULL, {name}({', '.join(args)}))" if len(args) > 1 else None


def _substr(args: list[str]) -> str | None:
    if len(args) != 3 or re.fullmatch(r"-?[1-9]\d*", args[1]):
        return None
    if args[1] == "0":
        return f"SUBSTRING({args[0]}, 1, GREATEST(({args[2]}) - 1, 0))"
    return f"IF(({args[1]}) = 0, SUBSTRING({args[0]}, 1, GREATEST(({args[2]}) - 1, 0)), SUBSTRING({args[0]}, {args[1]}, {args[2]}))"


def _listed(args: list[str]) -> str:
    m = re.match(r"(?i)distinct\s+", args[0])
    return f"LISTAGG({'DISTINCT ' if m else ''}CAST({args[0][m.end() if m else 0 :]} AS STRING), {args[1] if len(args) > 1 else repr(',')})"


CALLS: dict[str, Callable[[list[str]], str | None]] = {
    "strftime": _strftime, "date": _dated("yyyy-MM-dd"), "datetime": _dated("yyyy-MM-dd HH:mm:ss"), "time": _dated("HH:mm:ss"), "max": _extreme("GREATEST"), "min": _extreme("LEAST"), "substr": _substr, "substring": _substr,
    "iif": lambda a: f"IF({', '.join(a)})", "total": lambda a: f"COALESCE(SUM({', '.join(a)}), 0.0D)", "group_concat": _listed,
}


def _calls(sql: str) -> str:
    """Calls rewritten from the innermost outwards."""
    pattern = re.compile(r"(?i)(?<![\w.$])(" + "|".join([*CALLS, "cast"]) + r")\s*\(")
    done = len(sql)
    while True:
        mask = quote_mask(sql)
        found = [m for m in pattern.finditer(mask) if m.start() < done]
        if not found:
            return sql
        m = found[-1]
        end, done = _closing(mask, m.end() - 1), m.start()
        if end < 0:
            continue
        inner, name = sql[m.end() : end], m[1].lower()
        new = _cast(inner) if name == "cast" else CALLS[name](arguments(inner))
        if new is not None:
            sql = sql[: m.start()] + new + sql[end + 1 :]


def glob_pattern(glob: str) -> str:
    """A GLOB pattern as a regular expression for the whole text."""
    out, k = "", 0
    while k < len(glob):
        sign = glob[k]
        close = glob.find("]", k + 2) if sign == "[" else -1
        if close > 0:
            body = glob[k + 1 : close].replace("\\", "\\\\").replace("[", "\\[")
            out += "[" + body + "]"
            k = close
        else:
            out += {"*": "(?s:.*)", "?": "(?s:.)"}.get(sign) or re.escape(sign)
        k += 1
    return f"^{out}$"


def _glob(m: re.Match) -> str:
    quoted = "'" + glob_pattern(m[2][1:-1].replace("''", "'")).replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{m[1] or ''} RLIKE {quoted}"


def rewrite(sql: str) -> str:
    """Quoted identifiers, LIKE without regard to case, ==, GLOB, and the calls above, outside of texts."""
    sql = re.sub(_QUOTED, lambda m: m[0] if m[0][0] != '"' else "`" + m[0][1:-1].replace('""', '"').replace("`", "``") + "`", sql)
    sql = re.sub(r"(?i)(?<!\w)(not\s+)?glob\s+('(?:[^']|'')*')", _glob, sql) if re.search(r"(?i)\bglob\b", quote_mask(sql)) else sql
    parts = re.split(f"({_QUOTED})", sql)
    for k in range(0, len(parts), 2):
        for pattern, to in ((r"(?i)\b(?<!r)like\b", "ILIKE"), (r"==", "=")):
            parts[k] = re.sub(pattern, to, parts[k])
    return _calls("".join(parts))
