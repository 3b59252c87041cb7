"""Sharding by vector bin packing: bytes, tokens and rows are balanced at once.

Documents are packed in groups, each the documents of one source that share a hash bucket; a source has as many buckets as
make a group about 1/PIECES of a shard in its largest dimension, and a group is never split. There are as many shards as
SHARD_BYTES asks for. Groups and shards fall into cells of about CELL_SHARDS shards, each taking
its part of every source, so that each cell is packed alone, in one task. In a cell, the groups go from large to small, each to that shard, among those with room for it in
every dimension, where the dot product of its size with the shard's residual capacity is highest, all in shares of capacity.
A shard's capacity is its part of the cell plus ROOM. A group that fits nowhere goes where it overfills least.

`tokens` names a column with the number of tokens. Without it tokens are counted as runs of letters, runs of digits, and other
visible characters, a stand-in that needs no vocabulary and costs a tenth of encoding; the README says how true tokens balance.

Defined cases: null and empty texts have no bytes and tokens but are rows. Null source is a source. Rows that repeat a doc_id
go to one shard; rows of null doc_id are bucketed by their text. A document larger than a shard has a shard that it overfills.
An empty table has no rows. Ties go to the smaller group key and the lower shard. Further columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortmill.llm._work import small, written

SHARD_BYTES, PIECES, CELL_SHARDS, ROOM = 64 << 20, 32, 64, 0.02
DIMENSIONS = ("n_bytes", "n_tokens", "n_rows")


def token_estimate(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"))


def place(sizes: np.ndarray, shards: int, room: float = ROOM) -> np.ndarray:
    """The shard of each group, the groups (rows of `sizes`, a column for each dimension) taken in their order."""
    total = sizes.sum(axis=0, dtype=np.float64)
    capacity = np.where(total > 0, total, 1.0) / shards * (1.0 + room)
    share = sizes / capacity
    left = np.ones((shards, sizes.shape[1]))
    out = np.empty(len(sizes), np.int64)
    for g, need in enumerate(share):
        fits = (left >= need - 1e-12).all(axis=1)
        if fits.any():
            score = np.where(fits, np.round(left @ need, 12), -np.inf)  # rounded, so that ties are ties
        else:
            score = -np.round((need - left).max(axis=1), 12)
        at = int(np.argmax(score))
        out[g] = at
        left[at] -= need
    return out


def _pack(cell: pd.DataFrame) -> pd.DataFrame:
    cell = cell.copy()
    largest = (cell[list(DIMENSIONS)] / cell[list(DIMENSIONS)].sum().clip(lower=1)).max(axis=1).round(12)
    cell = cell.assign(largest=largest).sort_values(["largest", "grp"], ascending=[False, True], kind="stable")
    shards = int(cell["last_shard"].iloc[0] - cell["first_shard"].iloc[0])
    cell["shard"] = cell["first_shard"] + place(cell[list(DIMENSIONS)].to_numpy(np.float64), shards)
    return cell[["grp", "shard"]]


def assign_shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES, cell_shards: int = CELL_SHARDS, tokens: str | None = None) -> DataFrame:
    """(doc_id, source, n_bytes, n_tokens, shard) for each row of `docs`."""
    text = F.col("text").cast("string")
    counted = F.col(tokens).cast("bigint") if tokens else token_estimate(text).cast("bigint")
    rows = docs.select(
        F.col("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"),
        F.coalesce(counted, F.lit(0)).cast("bigint").alias("n_tokens"),
        F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(F.xxhash64("doc_id")).alias("spread"),
    )
    rows = written(rows, "shard-rows")
    sums = [F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_rows")]
    whole = rows.agg(*sums).first()
    shards = max(1, -(-(whole["n_bytes"] or 0) // shard_bytes))
    cells = -(-shards // cell_shards)
    part = F.greatest(*(F.col(d) / F.lit(max(1, whole[d] or 0)) for d in DIMENSIONS))
    sources = rows.groupBy("source").agg(*sums).select(F.col("source").alias("of"), F.greatest(F.lit(1), F.ceil(part * shards * PIECES)).cast("bigint").alias("buckets"))
    sources = written(sources, "shard-sources")
    rows = rows.join(small(sources, sources.count(), 64), F.col("source").eqNullSafe(F.col("of"))).withColumn("bucket", F.pmod("spread", "buckets"))
    # A source's buckets go round the shards, so that every cell has parts of every source in proportion to its shards.
    turn = F.pmod(F.col("bucket") + F.xxhash64("source"), F.lit(shards))
    cell = F.floor(((turn + 1) * cells - 1) / F.lit(shards)).cast("bigint")
    rows = rows.select("doc_id", "source", "n_bytes", "n_tokens", F.xxhash64("source", "bucket").alias("grp"), cell.alias("cell"))
    bound = lambda c: F.floor(c * shards / F.lit(cells)).cast("bigint")
    groups = rows.groupBy("grp", "cell").agg(*sums).withColumn("first_shard", bound(F.col("cell"))).withColumn("last_shard", bound(F.col("cell") + 1))
    packed = written(groups.groupBy("cell").applyInPandas(_pack, "grp bigint, shard bigint"), "shard-groups")
    return rows.join(small(packed, shards * PIECES * 2 + sources.count(), 32), "grp").select("doc_id", "source", "n_bytes", "n_tokens", "shard")
