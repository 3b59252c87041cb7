"""Ids that no two rows share, in the order in which batches are made."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortmill.operators.order import ranked

#: An id is the second of its batch, then so many bits for the row's number in the batch.
COUNTER_BITS = 24


def unique_ids(df: DataFrame, *by: Column, name: str = "id", second: int | None = None) -> DataFrame:
    """`df` with ids that ascend in the order of `by`, above those of every batch of an earlier second.

    A batch holds fewer than 2**COUNTER_BITS rows, else its later ids reach into the next second's, and that is an error.
    """
    base = (int(time.time()) if second is None else second) << COUNTER_BITS
    rows = ranked(df, *by, pos=name)
    over = F.raise_error(F.lit("more rows than a second has ids")).cast("bigint")
    return rows.withColumn(name, F.when(F.col(name) >= 1 << COUNTER_BITS, over).otherwise(F.col(name) + F.lit(base)))
