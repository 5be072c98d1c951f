"""Byte-level BPE encoding and decoding with a global shuffle of distinct words."""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches
from .vocabulary import default_path, encoder, pretokens, ranks

#: UTF-8 bytes of text that share one word list; a longer text has a list of its own.
CHUNK_BYTES = 24 << 20
#: Most bytes of words and their ids that an encoding task remembers, and what Python needs for a word besides.
REMEMBER_BYTES, WORD_COST = 128 << 20, 200

_MISSING = "a chunk's words are missing: the input gives other rows each time it is read; write it to a table first"


class _Chunk:
    """Words of a chunk numbered by first appearance, and each document's word numbers in order of position."""

    def __init__(self):
        self.words: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        self.ids, self.numbers, self.size = [], [], 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        text = text or ""
        self.size += len(text) + 64
        self.ids.append(doc_id)
        self.numbers.append(np.array(list(map(self.words.__getitem__, pretokens(text))), np.uint32))

    def key(self) -> bytes:
        """A digest of the word list and the ids: equal keys mean equal numbering, whichever task made the chunk, and chunks
        of copies of one text have keys of their own."""
        listed = ",".join(map(str, self.ids)) + "\x00" + "\x00".join(self.words)
        return xxhash.xxh3_128_digest(listed.encode("utf-8", "surrogatepass")) + len(self.words).to_bytes(4, "big")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Chunk]:
    chunk = _Chunk()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            chunk.add(doc_id, text.as_py())
            if chunk.size >= CHUNK_BYTES:
                yield chunk
                chunk = _Chunk()
    if chunk.ids:
        yield chunk


def _pack(values: list[bytes]) -> bytes:
    """Byte strings as one compressed value."""
    lengths = np.fromiter(map(len, values), "<u4", len(values))
    return zstandard.compress(len(values).to_bytes(4, "little") + _planes(lengths) + b"".join(values), 3)


def _unpack(packed: bytes) -> list[bytes]:
    raw = zstandard.decompress(packed)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(_unplanes(raw[4 : 4 + 4 * n])) + 4 + 4 * n
    return [raw[a:b] for a, b in itertools.pairwise([4 + 4 * n, *ends.tolist()])]


def _planes(numbers: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones and so on, which compresses better."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _words(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Exploded pre-tokens, once per chunk, dealt by a hash of the word: (bucket, chunk, word numbers, words), lists packed."""
    for chunk in _chunks(batches):
        key = chunk.key()
        dealt: list[tuple[list[int], list[bytes]]] = [([], []) for _ in range(buckets)]
        for number, word in enumerate(chunk.words):
            raw = word.encode("utf-8", "surrogatepass")
            numbers, words = dealt[zlib.crc32(raw) % buckets]
            numbers.append(number)
            words.append(raw)
        for bucket, (numbers, words) in enumerate(dealt):
            if words:
                steps = zstandard.compress(_planes(np.diff(np.array(numbers), prepend=0)), 3)
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([key], pa.binary()), pa.array([steps], pa.binary()), pa.array([_pack(words)], pa.binary())], ["bucket", "chunk", "numbers", "words"])


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions: (chunk, part, ids, lengths, packed word numbers) for some documents of a chunk."""
    for chunk in _chunks(batches):
        key = chunk.key()
        at = 0
        while at < len(chunk.ids):
            end, tokens = at, 0
            while end < len(chunk.ids) and (tokens < 1 << 20 or end == at):
                tokens += len(chunk.numbers[end])
                end += 1
            flat = np.concatenate(chunk.numbers[at:end])
            packed = zstandard.compress(_planes(flat), 3)
            lengths = [len(x) for x in chunk.numbers[at:end]]
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([chunk.ids[at:end]], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([packed], pa.binary())], ["chunk", "ids", "lengths", "packed"])
            at = end


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Encode each distinct word of the partition once; words are dealt out by their hash, so once in all. At most REMEMBER_BYTES
    of words and ids are held: beyond that the memory is emptied, and the commonest words soon are in it again."""
    single = encoder(path)._encode_single_piece
    known: dict[bytes, bytes] = {}
    held = 0
    for batch in batches:
        for row in range(batch.num_rows):
            out = []
            for word in _unpack(batch.column("words")[row].as_py()):
                ids = known.get(word)
                if ids is None:
                    if held > REMEMBER_BYTES:
                        known.clear()
                        held = 0
                    ids = known[word] = np.array(single(word), "<u4").tobytes()
                    held += len(word) + len(ids) + WORD_COST
                out.append(ids)
            yield pa.RecordBatch.from_arrays([batch.column("chunk").slice(row, 1), batch.column("numbers").slice(row, 1), pa.array([_pack(out)], pa.binary())], ["chunk", "numbers", "tokens"])


@cache
def token_bytes(path: str) -> list[bytes]:
    """The token-byte table: its size is the vocabulary's."""
    table = ranks(path)
    out = [b""] * (max(table.values()) + 1)
    for token, rank in table.items():
        out[rank] = token
    return out


def _reassemble(words: pa.Table, positions: pa.Table, path: str, finish: str) -> pa.Table:
    ids_of: dict[int, bytes] = {}
    for numbers, tokens in zip(words.column("numbers").to_pylist(), words.column("tokens").to_pylist(), strict=True):
        ids_of.update(zip(np.cumsum(_unplanes(zstandard.decompress(numbers))).tolist(), _unpack(tokens), strict=True))
    table = [np.frombuffer(ids_of[k], "<u4") if k in ids_of else None for k in range(max(ids_of, default=-1) + 1)]
    if any(x is None for x in table):
        raise RuntimeError(_MISSING)
    del ids_of
    lookup = token_bytes(path)
    sizes = np.array([len(x) for x in table], np.int64)
    numbers_of = [x.tolist() for x in table]
    texts = [" ".join(map(str, x)) for x in numbers_of]
    decoded = [b"".join(map(lookup.__getitem__, x)) for x in numbers_of]
    out: list[list] = [[], [], [], []]
    for row in range(positions.num_rows):
        ids, lengths = positions.column("ids")[row].as_py(), positions.column("lengths")[row].as_py()
        codes = _unplanes(zstandard.decompress(positions.column("packed")[row].as_py()))
        if len(codes) and codes.max() >= len(table):
            raise RuntimeError(_MISSING)
        at = 0
        for doc_id, n in zip(ids, lengths, strict=True):
            own = codes[at : at + n]
            at += n
            listed = own.tolist()
            data = b"".join(map(decoded.__getitem__, listed))
            out[0].append(doc_id)
            out[1].append(int(sizes[own].sum()))
            if finish == "digest":
                out[2].append(hashlib.sha256(" ".join(map(texts.__getitem__, listed)).encode()).hexdigest())
                out[3].append(hashlib.sha256(data).hexdigest())
            else:
                out[2].append(list(itertools.chain.from_iterable(map(numbers_of.__getitem__, listed))))
                out[3].append(data)
    if finish == "digest":
        return pa.table({"id": pa.array(out[0], pa.int64()), "n_tokens": pa.array(out[1], pa.int64()), "ids_sha256": pa.array(out[2], pa.string()), "decoded_sha256": pa.array(out[3], pa.string())})
    return pa.table({"id": pa.array(out[0], pa.int64()), "n_tokens": pa.array(out[1], pa.int64()), "ids": pa.array(out[2], pa.list_(pa.int32())), "decoded": pa.array(out[3], pa.binary())})


def bpe_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, digests: bool = False) -> DataFrame:
    """(id, n_tokens, ids, decoded bytes) for every row of docs, or digests of both in place of the last two.

    Pre-tokens are exploded with their positions: a chunk of documents lists its distinct words, and positions are word
    numbers. The words go through one global shuffle, where each distinct word is encoded once; ids come back to the
    chunk, are put in order of position, and decoded through the token-byte table. A word occurs once per chunk in that
    shuffle, so the commonest words make no hot task. Null texts equal empty ones: no tokens, empty bytes. Repeated rows
    each have a row; null ids stay null. The input is scanned twice and must give the same rows both times, else it fails.
    """
    bounded_batches(docs.sparkSession)
    path = path or default_path()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 16)
    words = rows.mapInArrow(partial(_words, buckets=buckets), "bucket int, chunk binary, numbers binary, words binary").repartition("bucket")
    encoded = words.mapInArrow(partial(_encode, path=path), "chunk binary, numbers binary, tokens binary")
    positions = rows.mapInArrow(_positions, "chunk binary, ids array<long>, lengths array<int>, packed binary")
    finish: Callable = partial(_reassemble, path=path, finish="digest" if digests else "full")
    schema = "id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary")
    out = encoded.groupBy("chunk").cogroup(positions.groupBy("chunk")).applyInArrow(finish, schema)
    return out.withColumnRenamed("id", id_col)
