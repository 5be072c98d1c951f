"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosine, components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import FloatType

from .common import join_groups, sorted_runs, stage, tile_hot_keys
from .components import connected_components, forest

#: Rows that a task compares at a time, buckets being kept whole: with vectors, and with sketches alone.
HELD_ROWS, HELD_SKETCHES = 1 << 15, 1 << 17
#: Bits of a sketch, and pairs of sketches that are compared at a time.
SKETCH, PAIRS = 128, 1 << 20
_RUN = ["key", "tile_a", "tile_b"]


def table_plan(rows: int, threshold: float, miss: float = 1e-3) -> tuple[int, int]:
    """Bits of a table and number of tables: buckets stay small as rows grow, and a link at the threshold is missed with at
    most probability `miss`."""
    bits = max(6, math.ceil(math.log2(max(rows, 2) / 16)))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-same))


def sketch_limit(threshold: float, miss: float = 1e-6) -> int:
    """Most bits in which the sketches of two vectors at the threshold differ, but for a probability `miss`."""
    p = math.acos(threshold) / math.pi
    left, d = 1.0, -1
    while left > miss:
        d += 1
        left -= math.comb(SKETCH, d) * p**d * (1 - p) ** (SKETCH - d)
    return d


@lru_cache(maxsize=4)
def _planes(size: int, bits: int, tables: int, seed: int = 20240607) -> np.ndarray:
    """Normals of the hyperplanes in whole numbers."""
    return np.rint(np.random.default_rng(seed + size).standard_normal((size, bits * tables)) * (1 << 16))


def _whole(vectors: np.ndarray) -> np.ndarray:
    """Vectors scaled to whole numbers, so that products are exact and a vector has the same signs in every task."""
    return np.rint(vectors / np.abs(vectors).max(axis=1, keepdims=True) * (1 << 20))


def _sketches(vectors: np.ndarray) -> np.ndarray:
    """Signs against SKETCH hyperplanes of their own as two numbers, the same for every table."""
    signs = _whole(vectors) @ _planes(vectors.shape[1], SKETCH, 1, 70240607) > 0
    return np.packbits(signs, axis=1).view(np.uint64)


def _codes(vectors: np.ndarray, bits: int, tables: int, first: int | None = None) -> np.ndarray:
    """Codes of the vectors in the first tables (default all)."""
    first = tables if first is None else first
    planes = _planes(vectors.shape[1], bits, tables)[:, : bits * first]
    scaled = _whole(vectors)
    out = np.zeros((len(vectors), first), np.uint32)
    step = max(1, (1 << 21) // max(bits * first, 1))
    for at in range(0, len(vectors), step):
        part = scaled[at : at + step]
        signs = (part @ planes > 0).reshape(len(part), first, bits)
        out[at : at + step] = (signs * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)
    return out


def _matrix(column: pa.Array, kind: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows by vector length: (row numbers, float64 matrix) of vectors packed as numbers of that kind."""
    raw = [np.frombuffer(x.as_py(), kind).astype(np.float64) for x in column]
    sizes = np.array([len(x) for x in raw])
    return {int(n): (at := np.flatnonzero(sizes == n), np.stack([raw[i] for i in at])) for n in np.unique(sizes)}


def in_range(v: np.ndarray) -> np.ndarray:
    """The vector, or if its square would be lost to overflow or underflow, the vector over a power of two; cosines stay."""
    top = np.abs(v).max()
    return v if 1e-130 < top < 1e130 else np.ldexp(v, -np.frexp(top)[1])


def _pack(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of the column's own kind of numbers; null where the vector is null, empty, zero, or holds null or non-finite components."""
    for batch in batches:
        out = []
        for x in batch.column(2):
            values = x.as_py()
            v = None
            if values and None not in values:
                v = np.array(values, np.float64) + 0.0
                v = in_range(v) if np.isfinite(v).all() and v.any() else None
            out.append(None if v is None else v.astype(kind).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["id", "label", "vec"])


def _deal(batches: Iterator[pa.RecordBatch], bits: int, tables: int, kind: str) -> Iterator[pa.RecordBatch]:
    """A row for each group of vectors and table, with the table's code and the sketch; vectors stay behind."""
    for whole in batches:
        for start in range(0, whole.num_rows, 1000):
            batch = whole.slice(start, 1000)
            for size, (at, m) in _matrix(batch.column("vec"), kind).items():
                codes, sketch = _codes(m, bits, tables), _sketches(m).view(np.int64)
                part = batch.take(pa.array(at))
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [part.column("gid"), part.column("label"), pa.array(np.full(len(at), t, np.int32)), pa.array(codes[:, t].astype(np.int64)), pa.array(np.full(len(at), size, np.int32)), pa.array(sketch[:, 0]), pa.array(sketch[:, 1])],
                        ["gid", "label", "t", "code", "size", "s0", "s1"],
                    )


def _cuts(key: np.ndarray, a: np.ndarray, b: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Where the runs of equal (key, tile_a, tile_b) begin in that order, and the end."""
    return np.flatnonzero(np.r_[True, (np.diff(key[order]) != 0) | (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0), True])


def _near(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of each bucket that have a row near them by sketch: at most one for each row, however many are near."""
    for rows in sorted_runs(batches, _RUN, HELD_SKETCHES):
        key, gid, tile, a, b, s0, s1 = (rows.column(k).to_numpy() for k in ("key", "gid", "tile", "tile_a", "tile_b", "s0", "s1"))
        order = np.lexsort((gid, b, a, key))
        sketch = np.stack([s0, s1], axis=1).view(np.uint64)
        kept = np.zeros(len(rows), bool)
        cut = _cuts(key, a, b, order)
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            at = order[lo:hi]
            cross, step = a[at[0]] != b[at[0]], max(1, PAIRS // len(at))
            for k in range(0, len(at) if len(at) > 1 else 0, step):
                some = at[k : k + step]
                near = np.bitwise_count(sketch[some, None] ^ sketch[None, at]).sum(axis=2) <= limit
                near &= (tile[some, None] != tile[None, at]) if cross else (some[:, None] != at[None, :])
                kept[some] |= near.any(axis=1)
        found = rows.filter(pa.array(kept)).select(["gid", "t", *_RUN, "tile"])
        yield from found.combine_chunks().to_batches()


def _verify(batches: Iterator[pa.RecordBatch], threshold: float, bits: int, tables: int, kind: str) -> Iterator[pa.RecordBatch]:
    """Exact cosines within each bucket: links as stars (v not null) and the number of partners first met here (v null)."""
    for rows in sorted_runs(batches, _RUN, HELD_ROWS):
        yield from _bucket_links(rows, threshold, bits, tables, kind)


def _bucket_links(rows: pa.Table, threshold: float, bits: int, tables: int, kind: str) -> Iterator[pa.RecordBatch]:
    key, node, copies, t, tile, a, b = (rows.column(k).to_numpy() for k in ("key", "node", "copies", "t", "tile", "tile_a", "tile_b"))
    order = np.lexsort((node, b, a, key))
    cut = _cuts(key, a, b, order)
    vec = rows.column("vec").combine_chunks()
    us, vs, ids, counts = [], [], [], []
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        at = order[lo:hi]
        if len(at) < 2:
            continue
        m = np.stack([np.frombuffer(vec[int(x)].as_py(), kind).astype(np.float64) for x in at])
        plain, here, c = m, int(t[at[0]]), None
        m = m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
        cross, number = a[at[0]] != b[at[0]], np.zeros(len(at), np.int64)
        for s in range(0, len(at), 1024):
            i, j = np.nonzero(m[s : s + 1024] @ m[s:].T >= threshold)
            i, j = i + s, j + s
            keep = (i < j) & ((tile[at[i]] != tile[at[j]]) if cross else True)
            i, j = i[keep], j[keep]
            if len(i) and c is None:
                c = _codes(plain, bits, tables, here)
            for x in range(0, len(i), 100_000):  # count a pair in the first table where its codes agree: here they do
                ii, jj = i[x : x + 100_000], j[x : x + 100_000]
                first = ~(c[ii] == c[jj]).any(axis=1)
                ii, jj = ii[first], jj[first]
                np.add.at(number, ii, copies[at[jj]])
                np.add.at(number, jj, copies[at[ii]])
                u, v = forest(node[at[ii]], node[at[jj]])
                us.append(u)
                vs.append(v)
        ids.append(node[at[number > 0]])
        counts.append(number[number > 0])
    if us:
        u, v = forest(np.concatenate(us), np.concatenate(vs))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.zeros(len(u), np.int64))], ["u", "v", "n"])
    if ids:
        u, n = np.concatenate(ids), np.concatenate(counts)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.nulls(len(u), pa.int64()), pa.array(n)], ["u", "v", "n"])


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, miss: float = 1e-3, tile_rows: int = 8_000) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of vectors.

    Rows link when labels, of any type, are equal and not null and the cosine in double precision is at least `threshold`. Vectors that
    are null, empty, zero or hold null or non-finite components link with nothing, as do null labels; vectors of other
    length never link. Identical vectors of a label meet as one row with their number, so copies don't multiply; n_links
    counts every other row linked directly. Tables hold codes and sketches of 16 bytes; vectors are fetched for the rows of a bucket
    that have another near them by sketch. Pairs at the threshold are missed with at most probability `miss`, closer ones with less; nothing
    else finds them, so recall is held against brute force. Links
    found in several tables count once. Rows that repeat an id count one by one; null ids form no link.
    """
    kind = "<f4" if isinstance(vectors.select(vector_col).schema[0].dataType.elementType, FloatType) else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    label = rows.schema["label"].dataType.simpleString()
    rows = stage(rows.mapInArrow(partial(_pack, kind=kind), f"id long, label {label}, vec binary"), "vectors")
    good = F.col("vec").isNotNull() & F.col("label").isNotNull() & F.col("id").isNotNull()
    groups = rows.filter(good).groupBy("label", "vec").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
    groups = stage(groups.withColumn("gid", F.monotonically_increasing_id()), "groups")
    bits, tables = table_plan(groups.count(), threshold, miss)
    dealt = groups.select("gid", "label", "vec").mapInArrow(partial(_deal, bits=bits, tables=tables, kind=kind), f"gid long, label {label}, t int, code long, size int, s0 long, s1 long")
    dealt = dealt.withColumn("key", F.xxhash64("label", "size", "t", "code")).drop("label", "code", "size")
    dealt = tile_hot_keys(dealt, "key", F.col("gid"), tile_rows).repartition(*_RUN).sortWithinPartitions(*_RUN)
    near = stage(dealt.mapInArrow(partial(_near, limit=sketch_limit(threshold)), "gid long, t int, key long, tile_a int, tile_b int, tile int"), "near")
    near = near.join(groups.select("gid", "node", "copies", "vec"), "gid").repartition(*_RUN).sortWithinPartitions(*_RUN)
    found = stage(near.mapInArrow(partial(_verify, threshold=threshold, bits=bits, tables=tables, kind=kind), "u long, v long, n long"), "links")
    number = found.filter("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    roots = connected_components(found.filter("v is not null").select("u", "v"), contracted=True)
    parts = groups.join(number, "node", "left").join(roots, "node", "left")
    parts = parts.select("label", "vec", F.coalesce("root", "node").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = join_groups(rows.filter(good), parts, groups, ["label", "vec"], "id").select("id", "n_links", "component_id")
    alone = rows.filter(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    both = linked.union(alone)
    return both.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
