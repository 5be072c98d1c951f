"""Incremental ingest: files that arrive in a folder, normalised like a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from lakeask.sources.tables import ingest


def read_arriving_csv(spark: SparkSession, folder: str, columns: list[str], numeric: list[str] = ()) -> DataFrame:
    """A stream of the CSV files put into a folder, columns as text, then the batch ingest."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return ingest(spark.readStream.csv(folder, schema=schema, header=True, escape='"'), list(numeric))


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Write what has arrived to Parquet, once; a later call goes on from the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
