"""Ordered scans of a keyed table: ranges (both ends included), prefixes, nearest keys, point lookups.

Bounds are plain predicates on key columns and so reach the Parquet scan. Rows are returned unordered where no order is asked for:
a distributed result has no order of its own, so `scan` gives each row its place, and a sink that needs order sorts by it.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortmill.operators.order import nearest, ranked
from sortmill.shared import fresh


def key_range(key: Column, low: Any = None, high: Any = None) -> Column:
    """low <= key <= high; None leaves an end open. Null keys are in no range, the unbounded one included."""
    ok = key.isNotNull()
    if low is not None:
        ok = ok & (key >= low)
    if high is not None:
        ok = ok & (key <= high)
    return ok


def scan(df: DataFrame, key: str, low: Any = None, high: Any = None, forward: bool = True, match: Column | None = None, pos: str | None = "pos") -> DataFrame:
    """Rows of the key range that fulfil the residual predicate, with their place in the scan."""
    rows = df.filter(key_range(F.col(key), low, high))
    if match is not None:
        rows = rows.filter(match)
    if pos is None:
        return rows
    return ranked(rows, F.col(key).asc() if forward else F.col(key).desc(), pos=pos)


def prefix_scan(df: DataFrame, prefixes: DataFrame, on: list[str]) -> DataFrame:
    """All rows whose leading key columns equal one of `prefixes`."""
    return df.join(prefixes.select(*on).distinct(), on, "left_semi")


def find_next(probes: DataFrame, probe: str, df: DataFrame, key: str, equal_ok: bool) -> DataFrame:
    """For each probe the smallest key above it (or equal, if allowed)."""
    return nearest(probes, probe, df, key, True, equal_ok)


def find_prev(probes: DataFrame, probe: str, df: DataFrame, key: str, equal_ok: bool) -> DataFrame:
    """For each probe the largest key below it (or equal, if allowed)."""
    return nearest(probes, probe, df, key, False, equal_ok)


def get_records(probes: DataFrame, probe: str, df: DataFrame, key: str, *values: str, status: str = "status") -> DataFrame:
    """Each probe with PRESENT or MISSING and the values of its record."""
    (own,) = fresh(probes, "own_key")
    held = df.select(F.col(key).alias(own), *values)
    state = F.when(F.col(own).isNull(), F.lit("MISSING")).otherwise(F.lit("PRESENT"))
    return probes.join(held, F.col(probe) == F.col(own), "left").select(*probes.columns, state.alias(status), *values)


def page(df: DataFrame, key: str, start: Any, count: int, after: bool = False) -> DataFrame:
    """The next `count` rows from a start key: a cursor that keeps no state between calls."""
    at = F.col(key) > start if after else F.col(key) >= start
    return df.filter(at).orderBy(key).limit(count)
