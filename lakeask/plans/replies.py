"""Reading lists of texts out of free-form replies."""

from __future__ import annotations

import json
import re


def _balanced(text: str) -> str | None:
    """From the first bracket to its partner, brackets inside quotes left out."""
    depth, quote, begin = 0, "", -1
    for k, sign in enumerate(text):
        if quote:
            quote = "" if sign == quote and text[k - 1] != "\\" else quote
        elif sign == '"':
            quote = sign
        elif sign == "[":
            begin = k if depth == 0 else begin
            depth += 1
        elif sign == "]" and depth:
            depth -= 1
            if depth == 0:
                return text[begin : k + 1]
    return None


def _flat(value: object, depth: int = 0) -> list[str]:
    if isinstance(value, str):
        return [value]
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return [str(value)]
    if isinstance(value, list) and depth <= 2:
        return [x for v in value for x in _flat(v, depth + 1)]
    return []


def text_list(reply: str | None) -> list[str] | None:
    """The texts of the first JSON array in a reply: by bracket depth, then the shortest and the widest stretch; single quotes
    and trailing commas are mended. None if nothing can be read."""
    reply = re.sub(r"(?is)<think>.*?</think>", "", reply or "")
    tries = [_balanced(reply)]
    for pattern in (r"(?s)\[.*?\]", r"(?s)\[.*\]"):
        found = re.search(pattern, reply)
        tries.append(found[0] if found else None)
    for attempt in filter(None, tries):
        for mended in (attempt, re.sub(r",\s*([\]}])", r"\1", attempt), re.sub(r",\s*([\]}])", r"\1", attempt.replace("'", '"').replace("“", '"').replace("”", '"'))):
            try:
                value = json.loads(mended)
            except ValueError:
                continue
            if isinstance(value, list):
                return _flat(value)
    return None
