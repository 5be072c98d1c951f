"""Packing token sequences by cutting-stock column generation."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import bounded_batches, stage
from .vocabulary import default_path, encoder, pretokens

#: Piece lengths are planned in units of so many tokens, so that the linear program has 1024 / QUANTUM rows at most.
QUANTUM = 4
#: Groups that the pieces of one length are dealt to for ranking; full pieces, the most by far in long texts, to more.
SALTS, FULL_SALTS = 64, 4096
#: Pre-tokens whose ids a worker remembers.
REMEMBER = 200_000


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Words(dict):
    """Packed ids of each pre-token, encoded once by the tokenizer; forgotten all at once when too many."""

    def __init__(self, path: str, ranks_path: str | None):
        super().__init__()
        self.path = path
        self.single = encoder(ranks_path)._encode_single_piece if ranks_path else None

    def __missing__(self, word: str) -> bytes:
        ids = self.single(word) if self.single else tokenizer(self.path).encode(word, add_special_tokens=False).ids
        packed = self[word] = np.array(ids, "<u4").tobytes()
        return packed


_known: dict[tuple, _Words] = {}


def special_strings(path: str) -> tuple[str, ...]:
    """Strings that the tokenizer takes as one token wherever they stand."""
    return tuple(t.content for t in tokenizer(path).get_added_tokens_decoder().values())


def encode(text: str | None, path: str, ranks_path: str | None = None, special: tuple[str, ...] | None = None) -> bytes:
    """Packed little-endian ids of the text, then id 0. Texts with a special token's string go to the tokenizer whole; the
    words of others are encoded one by one, from the same vocabulary as ranks where its path is given (it is faster)."""
    words = _known.get((path, ranks_path))
    if words is None:
        words = _known[path, ranks_path] = _Words(path, ranks_path)
    if special is None:
        special = special_strings(path)
    if len(words) > REMEMBER:
        words.clear()
    text = text or ""
    if any(s in text for s in special):
        ids = np.array(tokenizer(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    else:
        ids = b"".join(map(words.__getitem__, pretokens(text)))
    return ids + b"\0\0\0\0"


def _pieces(batches: Iterator[pa.RecordBatch], path: str, ranks_path: str | None, special: tuple[str, ...], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = encode(text.as_py(), path, ranks_path, special)
            for at in range(0, len(ids), 4 * size):
                part = ids[at : at + 4 * size]
                for column, value in zip(out, (doc_id, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["id", "start", "length", "ids_crc32", "doc_tokens"])


def price(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: item k (1 ...) has size k and values[k - 1]; best value and counts."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        n = min(c, len(values))
        with_item = values[:n] + best[c - n : c][::-1]
        k = int(with_item.argmax())
        if with_item[k] > best[c - 1] + 1e-12:
            best[c], choice[c] = with_item[k], k + 1
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(len(values), np.int64), capacity
    while c > 0:
        if choice[c]:
            counts[choice[c] - 1] += 1
            c -= choice[c]
        else:
            c -= 1
    return float(best[capacity]), counts


def first_basis(need: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(patterns in columns, times, inverse of the patterns) that hold `need` exactly, in fractions, the largest sizes first.

    A pattern is used until it exhausts one of its sizes, and later patterns don't hold that one: so there are as many
    patterns as sizes, in an order of sizes that makes the matrix triangular, and it is a basis of the linear program. It
    is inverted as it grows; einsum, as below, keeps to one thread, for which BLAS threads in a driver were seen to wait forever.
    """
    left, columns, times = need.copy(), [], []
    inverse = np.zeros((len(sizes), len(sizes)))
    while (open_ := left > 0).any():
        pattern, room = np.zeros(len(sizes), np.int64), capacity
        for k in np.flatnonzero(open_)[::-1]:
            pattern[k] = room // sizes[k]
            room -= pattern[k] * sizes[k]
        lasts = np.divide(left, pattern, out=np.full(len(sizes), np.inf), where=pattern > 0)
        out = int(lasts.argmin())
        if columns:
            inverse[len(columns)] = -np.einsum("j,jk->k", np.array([c[out] for c in columns], float), inverse[: len(columns)])
        inverse[len(columns), out] += 1
        inverse[len(columns)] /= pattern[out]
        columns.append(pattern)
        times.append(lasts[out])
        left -= lasts[out] * pattern
        left[open_] = np.maximum(left[open_], np.finfo(float).tiny)  # sizes that end together each get a pattern of their own
        left[out] = 0
    return np.array(columns).T, np.array(times), inverse


def column_generation(demand: np.ndarray, capacity: int, rounds: int = 20_000, gap: float = 1e-4) -> list[tuple[int, np.ndarray]]:
    """(times, pattern) that together hold `demand[k]` items of size k + 1.

    The linear program over patterns is solved by revised simplex steps: the basis inverse gives prices, the knapsack finds
    the pattern worth most at them, a ratio test lets it in. Each step's prices bound the optimum from below (Farley: the
    present sequences by the best pattern's worth), as does the sum of all sizes; it ends when the present sequences are
    within `gap` of the best bound, or after `rounds` steps. Times are rounded down, and first-fit decreasing patterns hold
    the few items left.
    """
    sizes = np.flatnonzero(demand)
    if not len(sizes):
        return []
    need = demand[sizes].astype(np.float64)
    basis, x, inverse = first_basis(need, sizes + 1, capacity)
    patterns = [np.bincount(sizes, weights=column, minlength=len(demand)).astype(np.int64) for column in basis.T]
    bound = float(need @ (sizes + 1)) / capacity
    for _ in range(rounds):
        values = np.zeros(len(demand))
        values[sizes] = np.maximum(inverse.sum(axis=0), 0)
        worth, pattern = price(values, capacity)
        bound = max(bound, float(values[sizes] @ need) / max(worth, 1))
        if x.sum() <= bound * (1 + gap) or worth <= 1 + 1e-9:
            break
        direction = np.einsum("ij,j->i", inverse, pattern[sizes].astype(np.float64))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(direction > 1e-9, x / direction, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = x - ratio[out] * direction
        x[out] = ratio[out]
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        patterns[out] = pattern
        x = np.maximum(x, 0)
    left, plan = demand.copy(), []
    for times, pattern in sorted(zip(np.floor(x + 1e-9).astype(np.int64).tolist(), patterns, strict=True), key=lambda p: -p[0]):
        used = pattern > 0
        if used.any():
            times = min(times, int((left[used] // pattern[used]).min()))
            if times > 0:
                left -= times * pattern
                plan.append((times, pattern))
    while left.any():  # what rounding leaves
        pattern, room = np.zeros(len(demand), np.int64), capacity
        for k in np.flatnonzero(left)[::-1]:
            n = min(int(left[k]), room // (int(k) + 1))
            pattern[k] += n
            room -= n * (int(k) + 1)
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        left -= times * pattern
        plan.append((times, pattern))
    return plan


def _segments(plan: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """(size class, first rank, first sequence): rank r of a class in a segment goes to sequence first + r - first rank."""
    rank, base, out = np.zeros(len(plan[0][1]) if plan else 0, np.int64), 0, []
    for times, pattern in plan:
        for k in np.flatnonzero(pattern):
            for _ in range(int(pattern[k])):
                out.append((int(k), int(rank[k]), base))
                rank[k] += times
        base += times
    return np.array(sorted(out), np.int64).reshape(-1, 3)


def _assign(batches: Iterator[pa.RecordBatch], segments: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
    starts = (segments[:, 0] << 44) + segments[:, 1]
    for batch in batches:
        kind, salt, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("kind", "salt", "rank"))
        rank = offsets[kind * SALTS + salt] + rank
        at = np.searchsorted(starts, (kind.astype(np.int64) << 44) + rank, side="right") - 1
        keep = [batch.column(batch.schema.get_field_index(n)) for n in ("id", "start", "length", "ids_crc32", "doc_tokens")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(segments[at, 2] + rank - segments[at, 1])], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for every piece of every document's ids with id 0 last.

    A document is cut at every `size` ids; the rests' length histogram (units of QUANTUM) goes to the column generation,
    and pieces ranked within their length class fill the pattern places. Only the histogram, of fixed size, reaches the
    driver. A sequence holds at most `size` ids; offsets in it run from 0 without a gap. Null texts equal empty ones: one
    piece, the id 0. Repeated rows and null ids are packed like any other. An empty table gives no piece.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if path is None:
        path, ranks_path = default_path("byte_bpe_50k.json"), default_path("byte_bpe_50k.tiktoken")
    rows = rows.mapInArrow(partial(_pieces, path=path, ranks_path=ranks_path, special=special_strings(path), size=size), "id long, start long, length long, ids_crc32 long, doc_tokens long")
    kind = F.ceil(F.col("length") / QUANTUM).cast("int") - 1
    kinds = -(-size // QUANTUM)
    salts = F.when(F.col("kind") == kinds - 1, FULL_SALTS).otherwise(SALTS)
    rows = stage(rows.withColumn("kind", kind).withColumn("salt", F.pmod(F.monotonically_increasing_id(), salts).cast("int")), "pieces")
    counts = np.zeros((kinds - 1) * SALTS + FULL_SALTS, np.int64)
    for k, salt, n in rows.groupBy("kind", "salt").count().collect():
        counts[k * SALTS + salt] = n
    firsts = np.arange(kinds) * SALTS
    demand = np.add.reduceat(counts, firsts)
    segments = _segments(column_generation(demand, size // QUANTUM)) if counts.any() else np.zeros((0, 3), np.int64)
    before = np.cumsum(counts) - counts
    offsets = before - np.repeat(before[firsts], np.diff(np.append(firsts, len(counts))))
    order = W.partitionBy("kind", "salt").orderBy("id", "start", "ids_crc32", "length", "doc_tokens")
    ranked = rows.withColumn("rank", (F.row_number().over(order) - 1).cast("long"))
    placed = ranked.mapInArrow(partial(_assign, segments=segments, offsets=offsets), "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long")
    earlier = W.partitionBy("sequence_id").orderBy(F.desc("length"), "id", "start", "ids_crc32", "doc_tokens").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0).cast("long")))
    return placed.withColumnRenamed("id", id_col)
