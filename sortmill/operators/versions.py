"""Versioned reads: every write is kept under its version, and a read picks each key's newest version that it may see.

Bounds compare user keys, both ends included. Versions of a key must differ. A null version is older than all others.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sortmill.operators.lsm import FULL, TOMBSTONE, TYPE, newest_wins, visible
from sortmill.shared import fresh


def namespace(df: DataFrame, ns: str, column: str = "ns") -> DataFrame:
    """The rows of one namespace, without its column; a partition column prunes files."""
    return df.filter(F.col(column) == ns).drop(column)


def snapshot(updates: DataFrame, keys: list[str], version: list[str], until: Column | None = None) -> DataFrame:
    """Each key's newest version among those that fulfil `until`, deleted keys hidden."""
    seen = updates if until is None else updates.filter(until)
    return visible(newest_wins(seen, keys, version))


def timestamp_snapshot(updates: DataFrame, keys: list[str], version: list[str], until: Column | None = None) -> DataFrame:
    """As `snapshot`, but of a store in which a deletion hides nothing: each key's newest full version."""
    seen = updates if until is None else updates.filter(until)
    return newest_wins(seen.filter(F.col(TYPE) != TOMBSTONE), keys, version)


def frozen(updates: DataFrame, version: str) -> Any:
    """The version number that a snapshot taken now would read up to; None of an empty log."""
    return updates.agg(F.max(version)).first()[0]


class Frozen(RuntimeError):
    """A write to a snapshot that was taken for reading only."""


class SnapshotStage:
    """A keyspace whose writes carry the number of the snapshot that was open when they were made.

    `updates` is a log with a column `version`; a write gives a new stage, and so does a snapshot, which closes the number before.
    A stage from `at` reads an older snapshot, and is frozen.
    """

    def __init__(self, updates: DataFrame, keys: list[str], current: int = 0, until: int | None = None) -> None:
        self.updates, self.keys, self.current, self.until = updates, keys, current, until

    def write(self, rows: DataFrame) -> "SnapshotStage":
        """The stage with `rows`, which are FULL unless they have an update type; tombstones are rows like others."""
        if self.until is not None:
            raise Frozen(f"snapshot {self.until} is frozen")
        kind = F.col(TYPE) if TYPE in rows.columns else F.lit(FULL)
        new = rows.withColumn(TYPE, kind).withColumn("version", F.lit(self.current).cast(self.updates.schema["version"].dataType))
        # A snapshot's own writes replace each other, the later ones last.
        old = self.updates.filter(F.col("version") == self.current).join(new.select(*self.keys).distinct(), self.keys, "left_anti")
        return SnapshotStage(self.updates.filter(F.col("version") != self.current).unionByName(old).unionByName(new, allowMissingColumns=True), self.keys, self.current)

    def delete(self, keys: DataFrame) -> "SnapshotStage":
        return self.write(keys.select(*self.keys).withColumn(TYPE, F.lit(TOMBSTONE)))

    def take(self) -> tuple["SnapshotStage", int]:
        """The stage to write on in, and the number under which what is there now stays readable."""
        return SnapshotStage(self.updates, self.keys, self.current + 1), self.current

    def at(self, number: int) -> "SnapshotStage":
        return SnapshotStage(self.updates, self.keys, number, number)

    def read(self) -> DataFrame:
        return snapshot(self.updates, self.keys, ["version"], None if self.until is None else F.col("version") <= self.until)


def cell_versions(cells: DataFrame, keys: list[str], version: str, count: int, until: Column | None = None) -> DataFrame:
    """The `count` newest versions of each cell."""
    seen = cells if until is None else cells.filter(until)
    (nth,) = fresh(cells, "nth")
    order = W.partitionBy(*keys).orderBy(F.col(version).desc())
    return seen.withColumn(nth, F.row_number().over(order)).filter(F.col(nth) <= count).drop(nth)


def row_maps(cells: DataFrame, row: str, column: str, version: str, value: str, until: Column | None = None) -> DataFrame:
    """Each row as a map from its columns to their newest values. Cells of a null column are left out."""
    seen = (cells if until is None else cells.filter(until)).filter(F.col(column).isNotNull())
    newest = newest_wins(seen.select(row, column, version, value), [row, column], [version])
    return newest.groupBy(row).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, value)))).alias("cells"))


def slice_columns(cells: DataFrame, row: str, column: str, names: list[str] | None = None, start: str | None = None, finish: str | None = None, reverse: bool = False, count: int = 100) -> DataFrame:
    """Each row's columns of a name list or range, in order, at most `count` of them."""
    kept = cells
    if names is not None:
        kept = kept.filter(F.col(column).isin(names))
    if start is not None:
        kept = kept.filter(F.col(column) <= start if reverse else F.col(column) >= start)
    if finish is not None:
        kept = kept.filter(F.col(column) >= finish if reverse else F.col(column) <= finish)
    order = W.partitionBy(row).orderBy(F.col(column).desc() if reverse else F.col(column).asc())
    (nth,) = fresh(cells, "nth")
    return kept.withColumn(nth, F.row_number().over(order)).filter(F.col(nth) <= count).drop(nth)


def slice_count(cells: DataFrame, row: str, column: str) -> DataFrame:
    """The number of different columns of each row."""
    return cells.groupBy(row).agg(F.countDistinct(column).alias("column_count"))


def counters(increments: DataFrame, keys: list[str], amount: Column) -> DataFrame:
    """The sum of each counter's increments."""
    return increments.groupBy(*keys).agg(F.sum(amount).alias("counter"))


def delete_cells(cells: DataFrame, doomed: DataFrame, keys: list[str], version: str, upto: str) -> DataFrame:
    """`cells` without those that a row of `doomed` deletes: same keys, version not above its `upto`."""
    (mark,) = fresh(cells, "mark")
    marks = doomed.groupBy(*keys).agg(F.max(upto).alias(mark))
    return cells.join(marks, keys, "left").filter(F.col(mark).isNull() | (F.col(version) > F.col(mark))).drop(mark)


def mutate_rows(cells: DataFrame, mutations: DataFrame, row: str, column: str, version: str) -> DataFrame:
    """`cells` after a batch of mutations (row, column, version, a value column, `deleted`): a deletion takes the cell's versions up to its own."""
    gone = mutations.filter("deleted").groupBy(row, column).agg(F.max(version).alias("upto"))
    kept = delete_cells(cells, gone, [row, column], version, "upto")
    return kept.unionByName(mutations.filter("NOT deleted").drop("deleted"))
