"""Document quality by a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_batches, sample_by_hash

#: Most labelled documents the model is fitted on.
TRAIN_DOCS = 6_000

_CLASS = np.zeros(256, np.uint8)
for _k, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"-()?", b"!#$%&*@^~<>{}[]\\/+=_`|"), 1):
    _CLASS[list(_set)] = _k
_NAMES = ("length", "upper", "digit", "punctuation", "symbol", "repeated", "word_length", "short_words", "word_symbols")


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each non-blank line of the text, and the line's length in bytes."""
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    if not lines:
        return np.zeros((0, len(_NAMES)), np.float32), np.zeros(0)
    raw = [x.encode("utf-8", "surrogatepass") for x in lines]
    size = np.array([len(x) for x in raw])
    kinds = _CLASS[np.frombuffer(b"".join(raw), np.uint8)]
    starts = np.concatenate(([0], np.cumsum(size)[:-1]))
    share = [np.add.reduceat(kinds == k, starts, dtype=np.int64) / size for k in (1, 2, 3, 4)]
    words = [x.split() for x in lines]
    n = np.array([len(w) for w in words])
    kinds_of = np.array([len(set(w)) for w in words])
    short = np.array([sum(map(3 .__ge__, map(len, w))) for w in words])
    symbols = share[3] * size / n
    out = np.stack([np.log1p(size) / 8, share[0] * 3, share[1] * 3, share[2] * 3, share[3] * 5, 1 - kinds_of / n, np.minimum(size / n, 40) / 20, short / n, np.minimum(symbols, 4) / 2], axis=1)
    return out.astype(np.float32), size.astype(np.float64)


def with_neighbours(own: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines before and after in its document (zeros at the ends), and a constant."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = documents[1:] == documents[:-1]
    before[1:][same], after[:-1][same] = own[:-1][same], own[1:][same]
    return np.concatenate([own, before, after, np.ones((len(own), 1), own.dtype)], axis=1)


@dataclass
class Field:
    """weights: emission score of `good`; moves: scores of bad-bad, bad-good, good-bad, good-good; slope and offset turn the
    log-odds of a document's length-weighted share of good lines into a probability; prior is for texts without lines."""

    weights: np.ndarray
    moves: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    prior: float = 0.0


def marginals(emission: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line by forward-backward over all documents at once, and expected counts of moves.

    Documents are ordered by length so that step t handles the first documents only: memory is that of the lines.
    """
    order = np.argsort(-lengths, kind="stable")
    sorted_lengths = lengths[order]
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))[order]
    steps = int(sorted_lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-sorted_lengths, -np.arange(1, steps + 1), side="right")
    m = moves.reshape(2, 2)
    forward, backward = np.zeros((len(emission), 2)), np.zeros((len(emission), 2))
    score = np.stack([np.zeros_like(emission), emission], axis=1)
    for t in range(steps):
        at = starts[: active[t]] + t
        if t == 0:
            forward[at] = score[at]
        else:
            last = forward[at - 1]
            forward[at, 0] = np.logaddexp(last[:, 0] + m[0, 0], last[:, 1] + m[1, 0]) + score[at, 0]
            forward[at, 1] = np.logaddexp(last[:, 0] + m[0, 1], last[:, 1] + m[1, 1]) + score[at, 1]
    for t in range(steps - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        after = backward[at + 1] + score[at + 1]
        backward[at, 0] = np.logaddexp(m[0, 0] + after[:, 0], m[0, 1] + after[:, 1])
        backward[at, 1] = np.logaddexp(m[1, 0] + after[:, 0], m[1, 1] + after[:, 1])
    both = forward + backward
    log_z = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - log_z)
    inner = np.ones(len(emission), bool)
    inner[starts[sorted_lengths > 0]] = False
    at = np.flatnonzero(inner)
    pair = forward[at - 1][:, :, None] + m[None] + (score[at] + backward[at])[:, None, :] - log_z[at][:, None, None]
    return good, np.exp(pair).sum(axis=0).ravel()


def fit(features: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, label: np.ndarray, rounds: int = 150, rate: float = 0.15, penalty: float = 1e-3) -> Field:
    """Gradient ascent (Adam) on the penalised likelihood; every line carries its document's label."""
    lines = np.repeat(label, lengths)
    w = np.zeros(features.shape[1] + 4)
    first, second = np.zeros_like(w), np.zeros_like(w)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))[lengths > 0]
    inner = np.ones(len(lines), bool)
    inner[starts] = False
    observed = np.array([np.sum(inner & (np.roll(lines, 1) == a) & (lines == b)) for a in (0, 1) for b in (0, 1)], float)
    for k in range(1, rounds + 1):
        good, moves = marginals(features @ w[:-4], lengths, w[-4:])
        step = np.concatenate([features.T @ (lines - good), observed - moves]) / max(len(lines), 1) - penalty * w
        first, second = 0.9 * first + 0.1 * step, 0.99 * second + 0.01 * step**2
        w += rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    field = Field(w[:-4], w[-4:])
    x = log_odds(features, lengths, sizes, field)
    seen = lengths > 0
    x, y = x[seen], label[seen]
    for _ in range(2000):  # logistic calibration on the same documents
        p = 1 / (1 + np.exp(-(field.slope * x + field.offset)))
        field.slope += 0.5 * (np.mean((y - p) * x) - 1e-3 * field.slope)
        field.offset += 0.5 * np.mean(y - p)
    field.slope = max(field.slope, 1e-3)
    return field


def log_odds(features: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, field: Field) -> np.ndarray:
    """Log-odds of the length-weighted mean marginal of each document; 0 for those without lines."""
    good, _ = marginals(features @ field.weights, lengths, field.moves)
    share = np.full(len(lengths), 0.5)
    seen = lengths > 0
    if seen.any():
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))[seen]
        share[seen] = np.add.reduceat(good * sizes, starts) / np.add.reduceat(sizes, starts)
    share = np.clip(share, 1e-3, 1 - 1e-3)
    return np.log(share / (1 - share))


def _featurise(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [line_features(t or "") for t in texts]
    lengths = np.array([len(p[0]) for p in parts], np.int64)
    own = np.concatenate([p[0] for p in parts]) if parts else np.zeros((0, len(_NAMES)), np.float32)
    return with_neighbours(own, np.repeat(np.arange(len(parts)), lengths)), lengths, np.concatenate([p[1] for p in parts]) if parts else np.zeros(0)


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own, size = line_features(text.as_py() or "")
            yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([own.tobytes()], pa.binary()), pa.array([size.tobytes()], pa.binary())], ["label", "own", "size"])


def _score(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 1000):
            batch = whole.slice(start, 1000)
            features, lengths, sizes = _featurise(batch.column(1).to_pylist())
            x = log_odds(features, lengths, sizes, field)
            score = np.where(lengths > 0, 1 / (1 + np.exp(-(field.slope * x + field.offset))), field.prior)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["id", "score"])


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = TRAIN_DOCS) -> Field:
    """A field from at most about train_docs labelled rows (by id hash) with `learn` true; only line features reach the driver.

    Without labelled rows, or with labels of one value only, the field scores every text by that share (0.5 without any).
    """
    chosen = sample_by_hash(labels.filter(learn & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")), F.col("id"), train_docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("y", "text")
    got = rows.mapInArrow(_collect, "label int, own binary, size binary").toPandas()
    label = got["label"].to_numpy(np.float64) if len(got) else np.zeros(0)
    if len(set(label)) < 2:
        share = float(label.mean()) if len(label) else 0.5
        return Field(np.zeros(3 * len(_NAMES) + 1), np.zeros(4), 1e-3, float(np.log(np.clip(share, 1e-3, 0.999) / np.clip(1 - share, 1e-3, 0.999))), 0.0)
    own = [np.frombuffer(x, np.float32).reshape(-1, len(_NAMES)) for x in got["own"]]
    lengths = np.array([len(x) for x in own], np.int64)
    features = with_neighbours(np.concatenate(own), np.repeat(np.arange(len(own)), lengths))
    return fit(features, lengths, np.concatenate([np.frombuffer(x) for x in got["size"]]), label)


def score_quality(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row from its whole text alone: the calibrated length-weighted share of good lines, 0 to 1.

    Null, empty and blank texts have no line and score 0. Repeated rows each have a row; ids may be null.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(_score, field=field), f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)
