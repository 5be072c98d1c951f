"""Shared plumbing: written stages in the shared folder, Arrow batch helpers, hot-key tiling."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from py4j.java_gateway import JavaObject
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines share, as the session names it in spark.checkpoint.dir. Where that is unset, a temporary one,
    which only a local master can do with."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lakeask-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_written: ContextVar[list[str] | None] = ContextVar("written", default=None)
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def _place(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def stage(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors. The table goes when the
    driver ends, or with the `scratch` it was written in, unless it is to `keep`."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lakeask-{label}-{uuid.uuid4().hex}"
    files, place = _place(spark, path)
    files.deleteOnExit(place)
    df.write.parquet(path)
    if not keep and (held := _written.get()) is not None:
        held.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(staged: DataFrame) -> None:
    """Delete a table that `stage` wrote and no later plan reads; any other frame is left alone."""
    if path := _paths.pop(staged, None):
        files, place = _place(staged.sparkSession, path)
        files.delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged within are deleted at the end, when what was made of them has been written."""
    token = _written.set(held := [])
    try:
        yield
    finally:
        _written.reset(token)
        for path in held:
            files, place = _place(spark, path)
            files.delete(place, True)


_UNITS = {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30, "t": 40, "tb": 40}


def bounded_batches(spark: SparkSession, rows: int = 1_000, size: int = 8 << 20) -> None:
    """Hold Arrow batches to a number of rows and bytes, so that a worker's memory doesn't follow the length of texts.

    Spark reads the two settings when a plan runs, so they are lowered in the session and stay so; lower ones are left alone.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = re.fullmatch(r"(-?\d+)\s*([a-z]*)", spark.conf.get(name).strip().lower())
        if not now or not 0 < int(now[1]) << _UNITS.get(now[2], 63) <= most:
            spark.conf.set(name, str(most))


def with_row_key(docs: DataFrame, name: str) -> DataFrame:
    """docs with a struct `name` (file, row) of each row's own, the same in every scan, whatever ids repeat or are null. A table
    read from Parquet has it for nothing; anything else is written first."""

    def keyed(df: DataFrame) -> DataFrame:
        place = df.metadataColumn("_metadata")
        return df.withColumn(name, F.struct(place["file_path"].alias("file"), place["row_index"].alias("row")))

    try:
        return keyed(docs)
    except AnalysisException:
        return keyed(stage(docs, "rows"))


def crc_of_id(column: Column) -> Column:
    """crc32 of the id as decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def sample_by_hash(df: DataFrame, key: Column, bound: int) -> DataFrame:
    """At most about `bound` rows, chosen by a hash of the key, the same ones in every run."""
    total = df.count()
    if total <= bound:
        return df
    return df.filter(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * bound / total))


def sample_each_by_hash(df: DataFrame, group: str, key: list[str], bound: int) -> DataFrame:
    """At most about `bound` rows, chosen by a hash of `key`, the same ones in every run. The bound is dealt evenly to the values
    of `group`, a text column without nulls, and what small ones leave goes to the others: a value keeps its rows at every size
    of the rest."""
    sizes = {r[0]: r[1] for r in df.groupBy(group).count().collect()}
    left, share = bound, {}
    for k, name in enumerate(sorted(sizes, key=sizes.get)):
        level = left / (len(sizes) - k)
        if sizes[name] > level:
            share[name] = level / sizes[name]
        left -= min(sizes[name], level)
    if not share:
        return df
    most = F.create_map(*[F.lit(x) for name, part in share.items() for x in (name, int((1 << 30) * part))])
    drawn = F.pmod(F.xxhash64(*key, F.lit("sample")), F.lit(1 << 30))
    return df.filter(drawn < F.coalesce(F.try_element_at(most, F.col(group)), F.lit(1 << 30)))


def sorted_runs(batches: Iterator[pa.RecordBatch], key: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of whole runs of equal key from a partition sorted by it. A table has about `rows` rows, more only where one
    run does, so that memory doesn't follow the size of the partition."""
    held: list[pa.Table] = []
    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
        if sum(map(len, held)) < rows:
            continue
        table = pa.concat_tables(held).combine_chunks()
        same = np.ones(len(table), bool)
        for name in key:
            values = table.column(name).to_numpy()
            same &= values == values[-1]
        whole = len(table) - int(np.argmin(same[::-1])) if not same.all() else 0
        if whole:
            yield table.slice(0, whole)
        held = [table.slice(whole)]
    if held:
        yield pa.concat_tables(held).combine_chunks()


def join_groups(rows: DataFrame, groups: DataFrame, sizes: DataFrame, key: list[str], member: str, least: int = 10_000) -> DataFrame:
    """Inner join of rows with the one row of their group; sizes, a written table, has each group's number of rows as `copies`.

    A group of more than a thousandth of all rows (and `least`) is cut into parts no larger by a hash of `member`, and its
    row is repeated for each, so that a group of copies makes no hot task. Fewer than a thousand groups can be so large,
    which bounds what is broadcast.
    """
    total = sizes.agg(F.sum("copies")).first()[0] or 0
    part = max(total // 1000, least)
    hot = sizes.filter(F.col("copies") > part).select(*key, F.ceil(F.col("copies") / part).cast("int").alias("parts"))
    if hot.isEmpty():
        return rows.join(groups, key)
    cut = F.coalesce("parts", F.lit(1))
    rows = rows.join(F.broadcast(hot), key, "left").withColumn("part", F.pmod(F.xxhash64(member), cut).cast("int")).drop("parts")
    groups = groups.join(F.broadcast(hot), key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), cut - 1))).drop("parts")
    return rows.join(groups, [*key, "part"]).drop("part")


def tile_hot_keys(rows: DataFrame, key: str, member: Column, tile_rows: int) -> DataFrame:
    """Split keys with more than tile_rows rows into pairs of tiles.

    Adds `tile` (this row's), `tile_a` and `tile_b` (the pair compared together). A key of at most tile_rows rows has the
    one pair (0, 0). A larger one is cut into k tiles by a hash of `member`; each row goes to the k pairs that hold its
    tile, so that every two rows of the key meet in some pair, and no task gets more than about two tiles of a key.
    """
    hot = rows.groupBy(key).count().filter(F.col("count") > tile_rows)
    if hot.isEmpty():
        return rows.withColumns({"tile": F.lit(0), "tile_a": F.lit(0), "tile_b": F.lit(0)})
    tiles = hot.select(F.col(key), F.ceil(F.col("count") / tile_rows).cast("int").alias("tiles"))
    dealt = rows.join(tiles, key, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64(member), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return dealt.withColumns({"tile_a": F.least("tile", "other"), "tile_b": F.greatest("tile", "other")}).drop("other", "tiles")
