"""Global order without a single task: rows are range-partitioned once, and what crosses partitions is carried over.

A window over the whole table would sort it in one task, and one over its ranges would shuffle it again. Here a table is laid out in
ranges of its sort columns; each range is sorted and numbered, or filled, in the very tasks that receive it, and written. After
that only one row for each range (its count, or its last key) goes through a small broadcast.

Null sort values come first. Ties of the sort columns are numbered in any order, so the columns should be a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from sortmill.shared import fresh, settled

#: The low bits of a monotonically increasing id are the row's number in its partition.
_IN_PARTITION = (1 << 33) - 1


def laid_out(df: DataFrame, by: list[Column], sort: list[Column], part: str, nth: str) -> DataFrame:
    """`df` in ranges of `by`, each sorted by `sort`, with the range's number, ascending, and the row's number in it from 0."""
    rows = df.repartitionByRange(*by).sortWithinPartitions(*sort)
    return rows.select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION)).alias(nth))


def _carried(per_range: DataFrame, part: str, value: Column, name: str) -> DataFrame:
    """For each range, `value` (an aggregate window expression) over all ranges before it."""
    order = W.orderBy(part)  # one row for each range: as many as there are shuffle partitions
    return F.broadcast(per_range.select(part, value.over(order.rowsBetween(W.unboundedPreceding, -1)).alias(name)))


def ranked(df: DataFrame, *by: Column, pos: str = "pos") -> DataFrame:
    """`df` with its place, from 1, in the order of `by`; a column named `pos` that it had is replaced."""
    df = df.drop(pos)
    part, nth, n, before = fresh(df, "range", "nth", "n", "before")
    laid = settled(laid_out(df, list(by), list(by), part, nth), "ranges")
    carry = _carried(laid.groupBy(part).agg(F.count("*").alias(n)), part, F.sum(n), before)
    place = (F.col(nth) + 1 + F.coalesce(before, F.lit(0))).cast("bigint")
    return laid.join(carry, part).select(*df.columns, place.alias(pos))


def _stepped(step: Callable[[pa.Array, pa.Scalar], tuple[pa.Array, pa.Scalar]], at: int, names: list[str]) -> Callable:
    """Batches with one more column, made by `step` from column `at` and what the batch before handed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            made, held = step(batch.column(at), pa.scalar(None, batch.column(at).type) if held is None else held)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names)

    return run


def _lagged(column: pa.Array, held: pa.Scalar) -> tuple[pa.Array, pa.Scalar]:
    return pa.concat_arrays([pa.array([held.as_py()], column.type), column[:-1]]), column[-1]


def _filled(column: pa.Array, held: pa.Scalar) -> tuple[pa.Array, pa.Scalar]:
    made = pc.fill_null(pc.fill_null_forward(column), held) if held.is_valid else pc.fill_null_forward(column)
    return made, made[-1]


def _with_step(rows: DataFrame, step: Callable, column: str, name: str) -> DataFrame:
    kind = T.StructType([*rows.schema.fields, T.StructField(name, rows.schema[column].dataType)])
    return rows.mapInArrow(_stepped(step, rows.columns.index(column), kind.names), kind)


def with_previous(df: DataFrame, by: list[Column], key: str, name: str) -> DataFrame:
    """`df` with the `key` of the row before each in the order of `by`; null for the first."""
    df = df.drop(name)
    part, nth, prev, last, carried = fresh(df, "range", "nth", "prev", "last", "carried")
    held = settled(_with_step(laid_out(df, by, by, part, nth), _lagged, key, prev), "ranges")
    ends = held.groupBy(part).agg(F.max_by(key, nth).alias(last))
    carry = _carried(ends, part, F.last(last, ignorenulls=True), carried)
    return held.join(carry, part).select(*df.columns, F.when(F.col(nth) == 0, F.col(carried)).otherwise(F.col(prev)).alias(name))


def nearest(probes: DataFrame, probe: str, keys: DataFrame, key: str, forward: bool, equal_ok: bool, found: str = "found_key") -> DataFrame:
    """Each row of `probes` with the nearest key after it (forward) or before it, null where there is none.

    Keys and probes are sorted together, so the cost is one range shuffle of both sides, whatever their sizes and skew.
    A null probe finds nothing; null keys are no keys; repeated keys count as one. A column named `found` is replaced.
    """
    columns = [c for c in probes.columns if c != found]
    at, own, part, nth, seen, end, carried = fresh(probes, "at", "own_key", "range", "nth", "seen", "end", "carried")
    sides = probes.select(*columns, F.col(probe).alias(at), F.lit(None).cast(keys.schema[key].dataType).alias(own))
    other = keys.filter(F.col(key).isNotNull()).select(F.col(key).alias(at), F.col(key).alias(own)).distinct()
    both = sides.unionByName(other, allowMissingColumns=True)
    # The last key met on the way is the nearest; at equal places the keys are met first if they may match, else last.
    way = F.col(at).desc() if forward else F.col(at).asc()
    tie = F.col(own).isNull() if equal_ok else F.col(own).isNotNull()
    filled = settled(_with_step(laid_out(both, [way], [way, tie.asc()], part, nth), _filled, own, seen), "ranges")
    ends = filled.groupBy(part).agg((F.min(own) if forward else F.max(own)).alias(end))
    carry = _carried(ends, part, F.last(end, ignorenulls=True), carried)
    hit = F.when(F.col(at).isNotNull(), F.coalesce(seen, carried))
    return filled.filter(F.col(own).isNull()).join(carry, part).select(*columns, hit.alias(found))
