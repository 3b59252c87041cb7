"""Streams of updates: each micro-batch becomes a generation of an update log, merged when it is read.

No state is held between batches: a batch is reduced to the newest update of each key and written under its own number,
and a batch that is run again after a failure overwrites itself. Readers see the newest update over all generations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sortmill.operators.lsm import merge_read
from sortmill.sources import updatelog


def stream_table(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """A Parquet table of `folder` as a stream, whether it is a file or a folder of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet")
    return reader.parquet(f"{folder}/{name}.parq*t")


def ingest(updates: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Starts a query that writes the stream as generations under `path`, and ends when what is there has been read."""

    def write(batch: DataFrame, number: int) -> None:
        updatelog.append(batch, path, number, keys, order)

    return updates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_so_far(updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The same as a stateful aggregate, for a sink in update mode: state grows with the keys, one row each."""
    rest = [c for c in updates.columns if c not in keys]
    best = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("best"))
    return best.select(*keys, *[F.col(f"best.{c}").alias(c) for c in rest])


def merged(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """What a reader sees of the ingested stream. Batches may arrive out of order, so `order` decides, not the generation."""
    return merge_read(updatelog.read(spark, path), keys, order)
