"""Public byte-level vocabulary: pattern, ranks, token bytes. Files are read from a path parameter, once per worker."""

from __future__ import annotations

import base64
import re
from functools import cache

#: The same language as public_tokenizers.PATTERN, in classes that Python's re matches faster (held against it in tests).
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def default_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def splitter():
    """The findall of the pattern itself, for texts outside ASCII and Latin letters where classes may differ."""
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN).findall


_PLAIN = re.compile(r"[\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ſ‘-”–—…]*\Z")


def pretokens(text: str) -> list[str]:
    """Matches of the public pattern. Only texts of characters on which both engines agree take the faster one."""
    return SPLIT.findall(text) if _PLAIN.match(text) else splitter()(text)


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@cache
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})
