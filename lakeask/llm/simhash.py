"""SimHash near-dedup: fingerprints, pivot distance tables, exact verification, components."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, join_groups, sorted_runs, stage, tile_hot_keys
from .components import connected_components, forest

#: Runs up to this length are compared by offset, longer ones by growing clusters.
SHORT_RUN = 48
#: Rows that a task compares at a time, runs being kept whole, and rows whose pivot distances are worked out at a time.
HELD_ROWS, TABLE_ROWS = 1 << 16, 1 << 13
_RUN = ["key", "tile_a", "tile_b"]


def fingerprint(text: str | None, words: int = 4) -> int:
    """SimHash of the lower-cased (A-Z) text's word shingles: a bit is 1 if set in over half the XXH64 hashes (seed 42)."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    whole = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(whole[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(x.as_py(), words) for x in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str, text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp), written: the fingerprint of each row's whole text; ids may be of any type."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return stage(rows.mapInArrow(partial(_fingerprints, words=words), f"id {kind}, fp long"), "prints")


def pivots(count: int = 64) -> np.ndarray:
    """Reference fingerprints: the rows of the 64-bit Walsh table, so that distances to them vary independently."""
    i, j = np.meshgrid(np.arange(count), np.arange(64), indexing="ij")
    bits = (np.bitwise_count(i & j) & 1).astype(np.uint8)
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)


def distance_table(prints: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distance of each fingerprint to each pivot, made slice by slice: the wide numbers of a slice only are held."""
    out = np.empty((len(prints), len(refs)), np.int8)
    for at in range(0, len(prints), TABLE_ROWS):
        out[at : at + TABLE_ROWS] = np.bitwise_count(prints[at : at + TABLE_ROWS, None] ^ refs[None, :])
    return out


def survivors(table: np.ndarray, i: np.ndarray, j: np.ndarray, distance: int) -> np.ndarray:
    """Mask of the pairs whose largest coordinate difference is at most distance; a true link always is (triangle inequality)."""
    alive = np.arange(len(i))
    for at in range(0, table.shape[1], 8):
        near = np.abs(table[i[alive], at : at + 8] - table[j[alive], at : at + 8]).max(axis=1) <= distance
        alive = alive[near]
    return alive


def _links(prints: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, distance: int) -> np.ndarray:
    alive = survivors(table, i, j, distance)
    return alive[np.bitwise_count(prints[i[alive]] ^ prints[j[alive]]) <= distance]


def _grow(prints: np.ndarray, table: np.ndarray, tile: np.ndarray, cross: bool, distance: int) -> list[tuple[int, int]]:
    """Spanning links of one long run: members already reached are not compared with one another again."""
    links, left = [], np.arange(len(prints))
    while len(left) > 1:
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            x = reached.pop()
            others = np.flatnonzero(tile[left] != tile[x]) if cross else np.arange(len(left))
            hits = others[_links(prints, table, np.full(len(others), x), left[others], distance)]
            if len(hits):
                new = left[hits]
                links += [(x, int(y)) for y in new]
                reached += new.tolist()
                left = np.delete(left, hits)
    return links


def _verify(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links within the runs of equal (key, tile_a, tile_b) of one sorted partition, as stars."""
    for rows in sorted_runs(batches, _RUN, HELD_ROWS):
        u, v = _run_links(rows, distance)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def _run_links(rows: pa.Table, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of fingerprints, which stand as signed numbers for themselves."""
    key, node, tile, a, b = (rows.column(k).to_numpy() for k in ("key", "fp", "tile", "tile_a", "tile_b"))
    order = np.lexsort((node, b, a, key))
    key, node, tile, a, b = (x[order] for x in (key, node, tile, a, b))
    fp = node.view(np.uint64)
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]), True])
    length = np.diff(new)
    run_end = np.repeat(new[1:], length)
    table = distance_table(fp, pivots())
    us, vs = [], []
    short = np.repeat(length, length) <= SHORT_RUN
    for d in range(1, min(SHORT_RUN, int(length.max()))):
        i = np.flatnonzero(short & (np.arange(len(fp)) + d < run_end))
        if not len(i):
            break
        i = i[(a[i] == b[i]) | (tile[i] != tile[i + d])]
        hit = i[_links(fp, table, i, i + d, distance)]
        us.append(node[hit])
        vs.append(node[hit + d])
    for k in np.flatnonzero(length > SHORT_RUN):
        s = slice(new[k], new[k + 1])
        found = np.array(_grow(fp[s], table[s], tile[s], a[s][0] != b[s][0], distance), np.int64).reshape(-1, 2)
        us.append(node[s][found[:, 0]])
        vs.append(node[s][found[:, 1]])
    none = [np.zeros(0, np.int64)]
    return forest(np.concatenate(us or none), np.concatenate(vs or none))


def block_masks(rows: int, distance: int) -> list[int]:
    """Masks such that fingerprints at most `distance` bits apart agree under one of them.

    64 bits are cut into distance + m blocks; some m of them must agree. m grows with the number of rows, so that a mask
    keeps about log2(rows) bits or more and the number of rows under one masked value stays small at every size.
    """
    m = 1
    while 64 * m // (distance + m) < np.log2(max(rows, 2)) - 1 and m < 6:
        m += 1
    edges = [64 * k // (distance + m) for k in range(distance + m + 1)]
    blocks = [(1 << hi) - (1 << lo) for lo, hi in itertools.pairwise(edges)]
    return [sum(c) - (1 << 64 if sum(c) >> 63 else 0) for c in itertools.combinations(blocks, m)]


def representatives(prints: DataFrame) -> DataFrame:
    """(fp, node, copies), written, for the distinct fingerprints of `prints` (id, fp): smallest id and number of rows."""
    return stage(prints.groupBy("fp").agg(F.min("id").alias("node"), F.count("*").alias("copies")), "reps")


def fingerprint_components(reps: DataFrame, distance: int = 4, tile_rows: int = 20_000) -> DataFrame:
    """(fp, component) for the fingerprints of `reps`, linked at `distance` or fewer differing bits: the smallest node of those
    reachable, nulls left out. Fingerprints themselves are what is linked, so nodes may be null or of any type."""
    masks = block_masks(reps.count(), distance)
    keys = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(masks)])
    keyed = reps.select("fp", F.explode(keys).alias("key"))
    dealt = tile_hot_keys(keyed, "key", F.col("fp"), tile_rows).repartition(*_RUN).sortWithinPartitions(*_RUN)
    edges = dealt.mapInArrow(partial(_verify, distance=distance), "u long, v long")
    roots = connected_components(edges, contracted=True).withColumnRenamed("node", "fp")
    rooted = reps.join(roots, "fp", "left").select("fp", "node", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("node").alias("component"))
    return rooted.join(least, "root").select("fp", "component")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) for every row of docs.

    Documents link when their fingerprints differ in at most `distance` bits; component_id is the smallest id reachable.
    Null and empty texts have fingerprint zero and link like any other. Rows that repeat an id are fingerprinted one by
    one; rows without an id link too, and have a null component only if no row of it has one. Equal fingerprints meet as one
    row, so copies never multiply. Candidate pairs come from masked fingerprints that links must share; the pivot distance
    tables discard those with a coordinate difference over `distance`, and the Hamming distance verifies the rest.
    """
    prints = fingerprints(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id", "text", words)
    reps = representatives(prints)
    found = join_groups(prints, fingerprint_components(reps, distance), reps, ["fp"], "id")
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
