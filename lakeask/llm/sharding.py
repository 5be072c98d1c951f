"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import stage

#: Virtual nodes of a shard; parts of an arc, by place, that its rows are ranked in; and parts for rows of hot texts, of which one has
#: more than one in HOT of all rows, so that no copies have a single task.
VIRTUAL_NODES, SALTS, HOT_SALTS, HOT = 64, 64, 64, 2000


def ring(shards: int, virtual: int = VIRTUAL_NODES) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all virtual nodes in order, and their shards. A shard's nodes don't depend on the other shards."""
    nodes = sorted((xxhash.xxh64_intdigest(f"{s}/{v}") - (1 << 63), s) for s in range(shards) for v in range(virtual))
    return np.array([p for p, _ in nodes], np.int64), np.array([s for _, s in nodes], np.int64)


def bounded_plan(demand: np.ndarray, owner: np.ndarray, capacity: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): arcs fill their own shard, then the overflow of each full shard goes on
    clockwise to the next node whose shard has room."""
    room = capacity.copy()
    segments: list[list[int]] = []
    over = []
    for arc, rows in enumerate(demand.tolist()):
        take = min(rows, int(room[owner[arc]]))
        room[owner[arc]] -= take
        if take:
            segments.append([arc, 0, take, int(owner[arc])])
        if rows > take:
            over.append((arc, take, rows))
    for arc, at, end in over:
        node = arc
        while at < end:
            node = (node + 1) % len(owner)
            take = min(end - at, int(room[owner[node]]))
            if take:
                room[owner[node]] -= take
                segments.append([arc, at, at + take, int(owner[node])])
                at += take
    slot = np.zeros(len(capacity), np.int64)
    out = []
    for arc, lo, hi, shard in sorted(segments):
        out.append((arc, lo, hi, shard, int(slot[shard])))
        slot[shard] += hi - lo
    return out


def _arcs(batches: Iterator[pa.RecordBatch], positions: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        arc = np.searchsorted(positions, batch.column(batch.schema.get_field_index("pos")).to_numpy()) % len(positions)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(arc.astype(np.int32))], [*batch.schema.names, "arc"])


def _place(batches: Iterator[pa.RecordBatch], plan: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
    starts = (plan[:, 0] << 40) + plan[:, 1]
    for batch in batches:
        get = {n: batch.column(k).to_numpy() for k, n in enumerate(batch.schema.names) if n in ("arc", "salt", "rank")}
        rank = offsets[get["arc"], get["salt"]] + get["rank"]
        at = np.searchsorted(starts, (get["arc"].astype(np.int64) << 40) + rank, side="right") - 1
        keep = [batch.schema.get_field_index(n) for n in ("id", "size", "text_crc32")]
        yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(plan[at, 3].astype(np.int32)), pa.array(plan[at, 4] + rank - plan[at, 1])], ["id", "size", "text_crc32", "shard", "slot"])


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law = 'rows', shard, slot, grown_shard = null) for every row of docs.

    A row's place on the ring is a hash of its text (null: empty), so equal texts stand together. The bound of a shard is its even
    share of the rows, so counts differ by at most one; rows beyond the bound go on clockwise, others stay where the ring has
    them, which limits movement when shards change. Equal texts are parted only where a shard is full, or by its end. Size is the
    text's UTF-8 bytes (null: none) plus 8. slot numbers a shard's rows from 0 without a gap. Null and repeated ids are rows like
    any other. Only counts of arcs - their number is fixed by the shards - and of at most HOT texts reach the driver; no text is
    shuffled.
    """
    positions, owner = ring(shards)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("pos"), F.monotonically_increasing_id().alias("number"))
    rows = stage(rows.mapInArrow(partial(_arcs, positions=positions), "id long, size long, text_crc32 long, pos long, number long, arc int"), "arcs")
    copies = rows.groupBy("pos").count()
    hot = copies.filter(F.col("count") > max(rows.count() // HOT, 1000)).select("pos", F.lit(True).alias("hot"))
    spread = F.pmod("number", F.lit(HOT_SALTS)) + SALTS
    salted = stage(rows.join(F.broadcast(hot), "pos", "left").withColumn("salt", F.when(F.col("hot"), spread).otherwise(F.pmod(F.xxhash64("pos"), F.lit(SALTS))).cast("int")).drop("hot", "number"), "salted")
    counts = np.zeros((len(owner), SALTS + HOT_SALTS), np.int64)
    for arc, salt, n in salted.groupBy("arc", "salt").count().collect():
        counts[arc, salt] = n
    total = int(counts.sum())
    capacity = np.full(shards, total // shards, np.int64) + (np.arange(shards) < total % shards)
    plan = np.array(bounded_plan(counts.sum(axis=1), owner, capacity), np.int64).reshape(-1, 5)
    offsets = np.cumsum(counts, axis=1) - counts
    ranked = salted.withColumn("rank", (F.row_number().over(W.partitionBy("arc", "salt").orderBy("pos", "id", "text_crc32", "size")) - 1).cast("long"))
    placed = ranked.mapInArrow(partial(_place, plan=plan, offsets=offsets), "id long, size long, text_crc32 long, shard int, slot long")
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
