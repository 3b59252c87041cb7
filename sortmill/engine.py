"""One place to open the stores of a data folder: documents, snapshots and replicated logs."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortmill.operators import documents, replog, versions
from sortmill.sources import updatelog


class Documents:
    """A collection with secondary indexes; a find takes the one that serves it best. Changes give a new collection without indexes."""

    def __init__(self, rows: DataFrame, pk: str, folder: str) -> None:
        self.rows, self.pk, self.folder = rows, pk, folder
        self.indexes: dict[tuple[str, ...], DataFrame] = {}

    def ensure_index(self, *fields: str) -> None:
        if fields not in self.indexes:
            path = f"{self.folder}/{'+'.join(fields)}"
            documents.ensure_index(self.rows, list(fields), self.pk, path)
            self.indexes[fields] = self.rows.sparkSession.read.parquet(path)

    def find(self, query: documents.Query) -> DataFrame:
        return documents.find_best(self.rows, query, self.pk, self.indexes)

    def _with(self, rows: DataFrame) -> "Documents":
        return Documents(rows, self.pk, self.folder)

    def insert(self, new: DataFrame) -> "Documents":
        return self._with(documents.insert(self.rows, new, self.pk))

    def update(self, query: documents.Query, spec: Mapping[str, Any], upsert: bool = False) -> "Documents":
        return self._with((documents.upsert if upsert else documents.update)(self.rows, query, spec, self.pk))

    def delete(self, query: documents.Query) -> "Documents":
        return self._with(documents.delete(self.rows, query))


class Replica:
    """One server's data and logs; `server` is the column that tells whose log an entry is of, `stamp` its place there."""

    def __init__(self, log: DataFrame, keys: list[str], server: str, stamp: str, instance: str) -> None:
        self.log, self.keys, self.server, self.stamp, self.instance = log, keys, server, stamp, instance

    def status(self) -> DataFrame:
        return replog.status(self.log, self.server, self.stamp)

    def actions(self, other: "Replica") -> DataFrame:
        """What this server must do with each of the other's logs."""
        return replog.resume(self.status(), other.status(), (self.instance, other.instance))

    def append(self, entries: DataFrame) -> "Replica":
        return Replica(replog.append_entries(self.log, entries, self.server, self.stamp), self.keys, self.server, self.stamp, self.instance)


class Engine:
    """Opens stores below one folder, each under a name of its own."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def documents(self, name: str, rows: DataFrame, pk: str) -> Documents:
        return Documents(rows, pk, f"{self.folder}/documents/{name}")

    def snapshots(self, rows: DataFrame, keys: list[str]) -> versions.SnapshotStage:
        """A stage whose first snapshot holds `rows`."""
        blank = rows.limit(0).withColumn(versions.TYPE, F.lit(versions.FULL)).withColumn("version", F.lit(0))
        return versions.SnapshotStage(blank, keys).write(rows)

    def log(self, name: str) -> str:
        """Where the update log of that name lives, for `append` and `read` of the update log."""
        return f"{self.folder}/logs/{name}"

    def write(self, name: str, gen: int, keys: list[str], sets: DataFrame | None = None, deletes: DataFrame | None = None) -> None:
        """A batch of rows to set and keys to delete, as one generation."""
        updatelog.append(updatelog.batch(sets, deletes, keys), self.log(name), gen, keys, [versions.TYPE])

    def get(self, name: str, keys: list[str]) -> DataFrame:
        return updatelog.read_merged(self.spark, self.log(name), keys)

    def replica(self, log: DataFrame, keys: list[str], server: str = "server", stamp: str = "logstamp", instance: str = "") -> Replica:
        return Replica(log, keys, server, stamp, instance)
