"""What the operators of this subpackage share beside `sortmill.shared`: its names in short, and the size of Arrow batches."""

from __future__ import annotations

from pyspark.sql import SparkSession

from sortmill.shared import discard, fresh, table
from sortmill.shared import settled as written
from sortmill.shared import sized as small

__all__ = ["ARROW_ROWS", "discard", "fresh", "slim_batches", "small", "table", "written"]

#: Rows of an Arrow batch, at most: texts are long, and a worker holds several copies of a batch.
ARROW_ROWS = 256


def slim_batches(spark: SparkSession) -> None:
    """Holds this session's Arrow batches to ARROW_ROWS, unless they are smaller already. This changes memory only."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))
