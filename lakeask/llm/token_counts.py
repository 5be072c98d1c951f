"""Token counts under a unigram model: dynamic programming shared along a trie of distinct pre-tokens."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches
from .vocabulary import default_path, pretokens, ranks


@cache
def unigram(path: str) -> tuple[dict[bytes, float], int]:
    """Log-probabilities of the vocabulary's tokens, Zipf by rank (rank r: proportional to 1 / (r + 2)), and the longest length."""
    table = ranks(path)
    total = math.log(sum(1 / (r + 2) for r in table.values()))
    return {t: -math.log(r + 2) - total for t, r in table.items()}, max(map(len, table))


class Trie:
    """Distinct pre-tokens as a byte trie. Every node has the best forward score and its token count, from its ancestors'."""

    def __init__(self, scores: dict[bytes, float], longest: int):
        self.scores, self.longest = scores, longest

    def count(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, int]]:
        """(word, tokens of its best segmentation); ties go to fewer tokens. Words are walked in sorted order, which is a
        depth-first walk of their trie: the scores of the path to the current node are held, so that a shared prefix is
        scored once, and only the path is in memory."""
        get, longest = self.scores.get, self.longest
        best, number, path = [0.0], [0], b""
        for word in sorted(words):
            depth = 0
            for x, y in zip(path, word, strict=False):
                if x != y:
                    break
                depth += 1
            del best[depth + 1 :], number[depth + 1 :]
            for end in range(depth + 1, len(word) + 1):
                top, least = -math.inf, 0
                for start in range(max(0, end - longest), end):
                    p = get(word[start:end])
                    if p is not None:
                        p += best[start]
                        if p > top or (p == top and number[start] < least):
                            top, least = p, number[start]
                best.append(top)
                number.append(least + 1)
            path = word
            yield word, number[-1]


#: Words a worker remembers between batches; beyond it the memory is emptied and filled anew.
REMEMBER = 300_000
_known: dict[str, dict[str, int]] = {}


def _counts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    scores, longest = unigram(path)
    # no token of a word can be longer than the word's own pieces; most vocabularies have a few very long runs of one sign
    trie = Trie(scores, longest)
    known = _known.setdefault(path, {})
    for whole in batches:
        for start in range(0, whole.num_rows, 500):
            batch = whole.slice(start, 500)
            texts = [pretokens(x.as_py() or "") for x in batch.column(1)]
            if len(known) > REMEMBER:
                known.clear()
            new = {w.encode("utf-8", "surrogatepass"): w for w in set().union(*texts) if w not in known} if texts else {}
            for word, n in trie.count(new):
                known[new[word]] = n
            tokens = [sum(map(known.__getitem__, t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(np.array([len(t) for t in texts], np.int64))], ["id", "n_tokens", "n_pretokens"])


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, n_pretokens) for every row of docs, over its whole text.

    n_tokens sums, over the pre-tokens of the text, the tokens of the best unigram segmentation. Null and empty texts have
    none. Repeated rows are counted each; a null id stays null. The vocabulary file is a parameter.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(partial(_counts, path=path or default_path()), "id long, n_tokens long, n_pretokens long")
    return out.withColumnRenamed("id", id_col)
