"""What a language model, a ranker and an embedder must offer, and deterministic stand-ins that need no network."""

from __future__ import annotations

import os
import re
import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from lakeask.functions.text import PROMPT_ECHOES
from lakeask.plans.replies import text_list

# Sampling temperatures of the generation paths.
PATHS = {"thinking_path": 0.5, "ICL_Path": 0.1, "Direct_Path": 0.4}


@dataclass
class Endpoint:
    """Where a chat model answers; read from the environment, with no default for place and model."""

    base_url: str
    model: str
    key: str = "EMPTY"

    @classmethod
    def from_environment(cls) -> Endpoint:
        missing = [n for n in ("LLM_BASE_URL", "LLM_MODEL") if not os.environ.get(n)]
        if missing:
            raise KeyError(f"set {', '.join(missing)}")
        return cls(os.environ["LLM_BASE_URL"], os.environ["LLM_MODEL"], os.environ.get("LLM_API_KEY", "EMPTY"))


class Generator(Protocol):
    def generate(self, path: str, question: str, schema: str, evidence: str, examples: list[tuple[str, str]], temperature: float) -> str: ...


class Paraphraser(Protocol):
    def paraphrase(self, questions: list[str]) -> list[str]: ...


class Repairer(Protocol):
    def repair(self, question: str, sql: str, problem: str, schema: str) -> str: ...


class EntityExtractor(Protocol):
    def extract(self, question: str, schema: str) -> list[str]: ...


@dataclass
class Tokens:
    """Token use, counted from any thread."""

    input_tokens: int = 0
    output_tokens: int = 0
    _lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def track(self, input_tokens: int, output_tokens: int) -> None:
        with self._lock:
            self.input_tokens += input_tokens
            self.output_tokens += output_tokens

    def report(self) -> dict[str, int]:
        return {"input_tokens": self.input_tokens, "output_tokens": self.output_tokens, "total_tokens": self.input_tokens + self.output_tokens}


class CodeEntities:
    """Stand-in extractor: quoted texts and code-like runs of the question."""

    def extract(self, question: str, schema: str) -> list[str]:
        quoted = re.findall(r"['\"“”‘’「」]([^'\"“”‘’「」]+)['\"“”‘’「」]", question)
        runs = [r for r in re.findall(r"[A-Za-z0-9]+", question) if any(x.isdigit() for x in r) and len(r) >= (6 if r.isdigit() else 3)]
        return list(dict.fromkeys([*quoted, *runs]))


def filter_entities(values: list[str], question: str, columns: list[str]) -> list[str]:
    """functions.text.entity_filter for one reply on the driver."""
    edge = ",.;:'\"`，。；：“”‘’、\t\n\x0b\x0c\r \u3000"
    bare = lambda t: re.sub(r"\s+", "", t)
    asked = bare(question)
    short = [bare(v) for v in (v.strip(edge) for v in values) if 0 < len(v) <= 80]
    return list(dict.fromkeys(v for v in short if v in asked and v not in columns and not any(e in v for e in PROMPT_ECHOES)))


@dataclass
class ModelEntities:
    """Entities that a chat model names as a JSON list: `ask` takes question and schema. A reply that can't be read is asked for once
    more; without any, the codes and quoted texts of the question stand in."""

    ask: Callable[[str, str], str]
    columns: list[str] = field(default_factory=list)
    attempts: int = 2

    def extract(self, question: str, schema: str) -> list[str]:
        for _ in range(self.attempts):
            try:
                found = text_list(self.ask(question, schema))
            except Exception:  # a call that fails counts as an attempt
                found = None
            if found is not None:
                return filter_entities(found, question, self.columns)
        return CodeEntities().extract(question, schema)


@dataclass
class Scripted:
    """Stand-in generator: replies looked up by question, the same for all paths or one for each."""

    replies: dict[str, str | dict[str, str]]

    def generate(self, path: str, question: str, schema: str, evidence: str, examples: list[tuple[str, str]], temperature: float = 0.0) -> str:
        reply = self.replies.get(question, "")
        return reply if isinstance(reply, str) else reply.get(path, "")


class LooseMatch:
    """Stand-in repairer: an equality with a literal that the column lacks becomes a LIKE with wildcards."""

    def repair(self, question: str, sql: str, problem: str, schema: str) -> str:
        return re.sub(r"=\s*'((?:[^'%]|'')+)'", r"LIKE '%\1%'", sql)


class SameWords:
    """Stand-in paraphraser."""

    def paraphrase(self, questions: list[str]) -> list[str]:
        return list(questions)
