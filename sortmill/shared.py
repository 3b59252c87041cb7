"""Tables that end a lineage, kept in the folder that the whole cluster shares; broadcasts of a checked size; free column names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only below this estimate of its bytes; beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20
#: What a broadcast row takes besides its values: the row's own header, and its place in the hash table.
ROW_BYTES = 48


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a folder of this machine, which serves a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="sortmill-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def path_of(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses and that goes when the application ends."""
    path = f"{shared_dir(spark)}/sortmill-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    at, fs = path_of(spark, path)
    fs.deleteOnExit(at)
    return path


def settled(df: DataFrame, name: str) -> DataFrame:
    """`df` as a written table: later reads see the same rows, whichever executors are lost."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._settled_at = path
    return back


def discard(df: DataFrame) -> None:
    """Deletes the table that `settled` wrote for `df`, which nothing may read any more."""
    at, fs = path_of(df.sparkSession, df._settled_at)
    fs.delete(at, True)


def sized(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """`df` with a broadcast hint if `rows` of `row_bytes` of values each are few enough, else as it is."""
    return F.broadcast(df) if rows * (row_bytes + ROW_BYTES) <= BROADCAST_BYTES else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like `names` that no column of `df` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
