"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_batches, sample_each_by_hash

ORDER = 4
DISCOUNT = 0.75
#: Most documents a model is fitted and its rejection limit calibrated on.
TRAIN_DOCS = 12_000
#: Nats by which a whole text must be over the limit, so that a few odd letters are no ground for rejection.
EVIDENCE = 30.0
#: Words whose scores a task remembers between batches.
REMEMBER = 200_000

_letters = re.compile(r"[^\W\d_]+").findall


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased. Runs of other numerals alone, such as superscripts, are none."""
    if not text:
        return []
    words = _letters(text.lower())
    return words if text.isascii() else [w for w in words if w.isalpha() or any(map(str.isalpha, w))]


def _grams(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of every character with its order - 1 predecessors, and each word's number of characters.

    A word is led by order - 1 zeros and ended by a space, so the context never reaches over a word's start.
    """
    pad = "\0" * (order - 1)
    points = np.frombuffer((pad + (" " + pad).join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    windows = np.lib.stride_tricks.sliding_window_view(points, order)
    return windows[windows[:, -1] != 0], np.array([len(w) + 1 for w in words], np.int64)


def _hash(grams: np.ndarray) -> np.ndarray:
    """64-bit hash of each row, salted by its length."""
    h = np.full(len(grams), 0x9E3779B97F4A7C15 * (grams.shape[1] + 1) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(grams.shape[1]):
        h ^= grams[:, k]
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


@dataclass
class Models:
    """One Kneser-Ney model per language, side by side: for each order the sorted hashes of the grams and contexts seen in any
    language, with a column of log-probabilities or back-off weights for each language."""

    langs: list[str]
    order: int
    grams: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    gamma: list[np.ndarray]
    floor: float
    limit: float = np.inf
    sharpness: float = 20.0

    def score(self, words: list[str]) -> np.ndarray:
        """Sum of log-probabilities of each word's characters, a column for each language."""
        if not words:
            return np.zeros((0, len(self.langs)))
        windows, length = _grams(words, self.order)
        out = np.zeros((len(windows), len(self.langs)))
        open_rows = np.arange(len(windows))
        for n in range(self.order, 0, -1):
            part = windows[open_rows, self.order - n :]
            at, found = _find(self.grams[n], _hash(part))
            out[open_rows[found]] += self.logp[n][at[found]]
            open_rows, part = open_rows[~found], part[~found]
            if not len(open_rows):
                break
            if n > 1:
                at, seen = _find(self.contexts[n], _hash(part[:, :-1]))
                out[open_rows[seen]] += self.gamma[n][at[seen]]
            else:
                out[open_rows] += self.floor
        return np.add.reduceat(out, np.concatenate(([0], np.cumsum(length)[:-1])), axis=0)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def fit(counts: dict[str, dict[str, int]], order: int = ORDER, discount: float = DISCOUNT) -> Models:
    """Models from each language's counts of grams of the highest order."""
    langs = sorted(counts)
    symbols = {g[-1] for c in counts.values() for g in c}
    uniform = 1 / (len(symbols) + 1)
    probs: list[dict[str, dict[int, float]]] = [defaultdict(dict) for _ in range(order + 1)]
    gammas: list[dict[str, dict[int, float]]] = [defaultdict(dict) for _ in range(order + 1)]
    full: list[list[dict[str, float]]] = [[{} for _ in langs] for _ in range(order + 1)]
    back: list[list[dict[str, float]]] = [[{} for _ in langs] for _ in range(order + 1)]
    for k, lang in enumerate(langs):
        levels: dict[int, dict[str, int]] = {order: counts[lang]}
        for n in range(order - 1, 0, -1):  # lower orders count how many different characters precede
            levels[n] = Counter(g[1:] for g in levels[n + 1])
        for n in range(1, order + 1):
            total, kinds = Counter(), Counter()
            for g, c in levels[n].items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            back[n][k] = {h: discount * kinds[h] / total[h] for h in total}
            for g, c in levels[n].items():
                lower = full[n - 1][k][g[1:]] if n > 1 else uniform
                full[n][k][g] = max(c - discount, 0) / total[g[:-1]] + back[n][k][g[:-1]] * lower

    def probability(n: int, k: int, g: str) -> float:
        p = full[n][k].get(g)
        if p is None:
            p = back[n][k].get(g[:-1], 1.0) * (probability(n - 1, k, g[1:]) if n > 1 else uniform)
        return p

    for n in range(1, order + 1):
        for g in set().union(*full[n]):
            probs[n][g] = {k: probability(n, k, g) for k in range(len(langs))}
        for h in set().union(*back[n]):
            gammas[n][h] = {k: back[n][k].get(h, 1.0) for k in range(len(langs))}

    def table(entries: dict[str, dict[int, float]], width: int) -> tuple[np.ndarray, np.ndarray]:
        names = list(entries)
        points = np.array([[ord(c) for c in g] for g in names], np.uint32).reshape(len(names), width)
        keys = _hash(points)
        by = np.argsort(keys)
        values = np.log(np.array([[entries[g][k] for k in range(len(langs))] for g in names]).reshape(len(names), len(langs)))
        return keys[by], values[by]

    grams, contexts = [table(probs[n], n) for n in range(order + 1)], [table(gammas[n], max(n - 1, 0)) for n in range(order + 1)]
    return Models(langs, order, [x[0] for x in grams], [x[1] for x in grams], [x[0] for x in contexts], [x[1] for x in contexts], float(np.log(uniform)))


def _count(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts[lang].update(words_of(text.as_py()))
    for lang, words in counts.items():
        grams: Counter = Counter()
        for word, c in words.items():
            padded = "\0" * (order - 1) + word + " "
            for i in range(len(word) + 1):
                grams[padded[i : i + order]] += c
        if grams:
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array([g.encode("utf-8", "surrogatepass") for g in grams], pa.binary()), pa.array(list(grams.values()), pa.int64())], ["lang", "gram", "n"])


class WordScores(dict):
    """Row numbers of the scores of words already seen; at most REMEMBER words and those of one batch are held."""

    def __init__(self, models: Models):
        super().__init__()
        self.models, self.sums, self.sizes = models, np.zeros((0, len(models.langs))), np.zeros(0, np.int64)

    def learn(self, lists: list[list[str]]) -> None:
        if len(self) > REMEMBER:
            self.clear()
            self.sums, self.sizes = self.sums[:0], self.sizes[:0]
        new = [w for w in set().union(*lists) if w not in self]
        if new:
            self.update(zip(new, range(len(self), len(self) + len(new)), strict=True))
            parts = [self.models.score(new[i : i + 10_000]) for i in range(0, len(new), 10_000)]
            self.sums = np.concatenate([self.sums, *parts])
            self.sizes = np.concatenate([self.sizes, [len(w) + 1 for w in new]])


def entropies(texts: list[str | None], seen: WordScores) -> tuple[np.ndarray, np.ndarray]:
    """Length-normalised cross-entropy (nats a character) of each text in each language, and its number of characters."""
    lists = [words_of(t) for t in texts]
    seen.learn(lists)
    out, chars = np.zeros((len(texts), len(seen.models.langs))), np.zeros(len(texts), np.int64)
    for row, words in enumerate(lists):
        if words:
            at = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
            chars[row] = seen.sizes[at].sum()
            out[row] = -seen.sums[at].sum(axis=0) / chars[row]
    return out, chars


def _predict(batches: Iterator[pa.RecordBatch], models: Models, text_at: int, id_at: int, carry: list[int]) -> Iterator[pa.RecordBatch]:
    names, seen = np.array([*models.langs, "und"], object), WordScores(models)
    for whole in batches:
        for start in range(0, whole.num_rows, 500):
            batch = whole.slice(start, 500)
            cross, chars = entropies(batch.column(text_at).to_pylist(), seen)
            if models.langs:
                best = cross.argmin(axis=1)
                lowest = cross[np.arange(len(best)), best]
                weight = np.exp(-(cross - lowest[:, None]) * models.sharpness)
                score = 1 / weight.sum(axis=1)
            else:
                best, lowest, score, chars = np.zeros(len(cross), int), np.zeros(len(cross)), np.zeros(len(cross)), np.zeros(len(cross))
            none = chars == 0
            best = np.where(none, len(models.langs), best)
            score = np.where(none, 0.0, score)
            rejected = none | ((lowest - models.limit) * np.maximum(chars, 1) > EVIDENCE)
            out = [batch.column(id_at), pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(np.where(none, np.nan, lowest), from_pandas=True), pa.array(rejected), *[batch.column(k) for k in carry]]
            yield pa.RecordBatch.from_arrays(out, [f"o{k}" for k in range(len(out))])


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> Models:
    """Models from at most about train_docs rows with `learn` true and a language; counts are made distributedly. The rows are
    dealt evenly to the languages and chosen by a hash of id and text, so that a rare language has a model at every size.

    The rejection limit is calibrated on the same rows: the largest cross-entropy of a row plus a quarter, or three
    fifths of the way from the median to that of even odds if more, so that known text is kept and only text unlike every
    language is rejected.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).cast("string").alias("id"))
    bounded = sample_each_by_hash(rows, "lang", ["id", "text"], train_docs)
    table = bounded.select("lang", "text").mapInArrow(partial(_count, order=ORDER), "lang string, gram binary, n long")
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for lang, gram, n in table.groupBy("lang", "gram").agg(F.sum("n")).toLocalIterator():
        counts[lang][bytes(gram).decode("utf-8", "surrogatepass")] = n
    models = fit(counts)
    if models.langs:
        scored = identify(bounded, models, "id", "text")
        top, mid = scored.agg(F.max("cross_entropy"), F.percentile_approx("cross_entropy", 0.5)).first()
        if top is not None:
            models.limit = max(1.25 * top, mid + 0.6 * (-models.floor - mid))
    return models


def identify(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(id, lang_pred, score, cross_entropy, rejected, struct `carried` of columns) for every row, from its whole text alone.

    lang_pred has the lowest length-normalised cross-entropy (ties: first by name), or `und` with score 0 if the text is
    null or has no letter, or no language was learned. score is the weight of the best language against the others.
    `rejected` marks `und` and texts whose lowest cross-entropy is over the calibrated limit. Repeated rows each have a row.
    """
    carry = carry or []
    bounded_batches(docs.sparkSession)
    names = list(dict.fromkeys([id_col, text_col, *carry]))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])
    kinds = [f.dataType.simpleString() for f in rows.schema]
    at = [names.index(c) for c in carry]
    schema = ", ".join(f"o{k} {t}" for k, t in enumerate([kinds[0], "string", "double", "double", "boolean", *[kinds[k] for k in at]]))
    found = rows.mapInArrow(partial(_predict, models=models, text_at=names.index(text_col), id_at=0, carry=at), schema)
    found = found.toDF(id_col, "lang_pred", "score", "cross_entropy", "rejected", *[f"c{k}" for k in range(len(carry))])
    if not carry:
        return found
    return found.select(*found.columns[:5], F.struct(*[F.col(f"c{k}").alias(c) for k, c in enumerate(carry)]).alias("carried"))
