"""An update log on disk: one folder of sorted files for each generation, `gen=<n>`.

A generation is written at once and replaced as a whole, so a repeated write of the same generation changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortmill.operators.lsm import FULL, TOMBSTONE, TYPE, compact, merge_read, newest_wins, write_segments


def append(updates: DataFrame, path: str, gen: int, keys: list[str], order: list[str]) -> None:
    """The newest update of each key as a generation."""
    newest = newest_wins(updates.drop("gen"), keys, order)
    by = list(keys)
    newest.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/gen={gen}")


def batch(sets: DataFrame | None, deletes: DataFrame | None, keys: list[str]) -> DataFrame:
    """A batch of writes as updates: rows to set, and keys to delete. A key may stand on one side only."""
    sides = []
    if sets is not None:
        sides.append(sets.withColumn(TYPE, F.lit(FULL)))
    if deletes is not None:
        sides.append(deletes.select(*keys).distinct().withColumn(TYPE, F.lit(TOMBSTONE)))
    return sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1], allowMissingColumns=True)


def record_update(updates: DataFrame, key: dict) -> DataFrame:
    """All that the log holds of one key, tombstones included, before any merge."""
    for name, value in key.items():
        updates = updates.filter(F.col(name) == value)
    return updates


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All updates with their generation; a filter on `gen` prunes folders."""
    reader = spark.read.option("basePath", path)
    return (reader.schema(schema) if schema else reader).parquet(f"{path}/gen=*")


def read_merged(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    return merge_read(read(spark, path), keys, ["gen"])


def compact_to(spark: SparkSession, path: str, keys: list[str], target: str) -> None:
    """The log at `path` compacted into one generation of a new log at `target`."""
    merged = compact(read(spark, path), keys, ["gen"])
    write_segments(merged.drop("gen", "target_gen"), keys, f"{target}/gen=0")
