"""Replication logs of several servers: status, tails, replay, and what a server must do to catch up.

A log is rows (server, logstamp, ...) with ascending stamps per server. A server without entries has no row; null stamps are no entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sortmill.operators.lsm import merge_read
from sortmill.shared import fresh, sized


def status(log: DataFrame, server: str, stamp: str) -> DataFrame:
    """(server_guid, oldest_entry_pointer, log_commit_head)."""
    held = log.filter(F.col(stamp).isNotNull())
    return held.groupBy(F.col(server).alias("server_guid")).agg(F.min(stamp).alias("oldest_entry_pointer"), F.max(stamp).alias("log_commit_head"))


def tail(log: DataFrame, server: str, stamp: str, of: str | None, after: int) -> DataFrame:
    """(server_guid, logstamp) of entries behind `after`."""
    rows = log.filter(F.col(stamp) > after)
    if of is not None:
        rows = rows.filter(F.col(server) == of)
    return rows.select(F.col(server).alias("server_guid"), F.col(stamp).alias("logstamp"))


def has_gap(log: DataFrame, server: str, stamp: str, of: str, start: int) -> bool:
    """Whether a reader at `start` has lost entries: its own entry is gone. Stamp 0 is the beginning, before any entry."""
    return start != 0 and log.filter((F.col(server) == of) & (F.col(stamp) == start)).limit(1).count() == 0


def fetch(log: DataFrame, server: str, stamp: str, of: str, start: int, limit: int | None = None) -> DataFrame:
    """The entries behind `start`, in order, exactly `limit` of them at most; LookupError if the log no longer holds `start`."""
    if has_gap(log, server, stamp, of, start):
        raise LookupError(f"log of {of} does not hold {start}")
    rows = log.filter((F.col(server) == of) & (F.col(stamp) > start)).orderBy(stamp)
    return rows if limit is None else rows.limit(limit)


def remaining(log: DataFrame, server: str, stamp: str, after: int) -> DataFrame:
    """(server_guid, remaining): entries behind `after`; servers with none have no row."""
    return tail(log, server, stamp, None, after).groupBy("server_guid").agg(F.count("*").alias("remaining"))


def append_entries(log: DataFrame, entries: DataFrame, server: str, stamp: str) -> DataFrame:
    """`log` with new entries of one server each, stamped after its head in the order of their own `stamp`: 1, 2, ... behind it."""
    head, own, nth = fresh(entries, "head", "own", "nth")
    heads = log.groupBy(F.col(server).alias(own)).agg(F.max(stamp).alias(head))
    order = F.row_number().over(W.partitionBy(server).orderBy(stamp))
    new = entries.withColumn(nth, order).join(heads, F.col(server) == F.col(own), "left")
    return log.unionByName(new.withColumn(stamp, (F.coalesce(head, F.lit(0)) + F.col(nth)).cast(log.schema[stamp].dataType)).select(*log.columns))


def same_instance(ours: str, theirs: str) -> None:
    """ValueError unless both servers hold the same data instance: their logs cannot be compared otherwise."""
    if ours != theirs:
        raise ValueError(f"data instance {theirs} is not {ours}")


def rebuilt(source: DataFrame, log: DataFrame, keys: list[str], stamp: str, until: int) -> tuple[DataFrame, DataFrame]:
    """A replica made anew: what another server's updates show up to `until`, nothing of its own, and of the log the heads up to there."""
    data = merge_read(source.filter(F.col(stamp) <= until), keys, [stamp])
    return data, log.filter(F.col(stamp) <= until)


def resume(ours: DataFrame, theirs: DataFrame, instances: tuple[str, str] | None = None) -> DataFrame:
    """(g, action) for each of their logs, from two `status` tables: rebuild, resolve or replay.

    `instances` names our data instance and theirs; where they differ that is an error.
    """
    if instances:
        same_instance(*instances)
    mine = ours.select(F.col("server_guid").alias("g"), F.col("log_commit_head").alias("mine"))
    their = theirs.select(F.col("server_guid").alias("g"), F.col("oldest_entry_pointer").alias("oldest"), F.col("log_commit_head").alias("head"))
    action = (
        F.when(F.col("mine").isNull() & (F.col("oldest") != 0), "rebuild")
        .when(F.col("mine") < F.col("oldest"), "rebuild")
        .when(F.col("mine") > F.col("head"), "resolve")
        .otherwise("replay")
    )
    return their.join(mine, "g", "left").select("g", action.alias("action"))


def decision(actions: DataFrame) -> DataFrame:
    """(decision): the worst action of all logs; a log that must be rebuilt is never passed over for one to be resolved."""
    rank = F.when(F.col("action") == "rebuild", 2).when(F.col("action") == "resolve", 1).otherwise(0)
    return actions.agg(F.max_by("action", rank).alias("decision"))


def applied(log: DataFrame, key: str, stamp: str, servers: list[str], server: str = "server") -> DataFrame:
    """(key, last_logstamp, applied): the entries of some servers replayed, by the key that they write."""
    rows = log.filter(F.col(server).isin(servers))
    return rows.groupBy(key).agg(F.max(stamp).alias("last_logstamp"), F.count("*").alias("applied"))


def replay(data: DataFrame, entries: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """The data after the entries: both are updates, and the newest stamp of a key wins."""
    return merge_read(data.unionByName(entries), keys, [stamp])


def truncated(log: DataFrame, server: str, stamp: str) -> DataFrame:
    """Each server's newest entry alone."""
    own, last = fresh(log, "own", "last")
    head = log.groupBy(F.col(server).alias(own)).agg(F.max(stamp).alias(last))
    return log.join(head, (F.col(server) == F.col(own)) & (F.col(stamp) == F.col(last)), "left_semi")


def lag(log: DataFrame, server: str, stamp: str, seen: DataFrame, near: int = 5, lost: int = 30) -> DataFrame:
    """(server_guid, behind, state): entries not yet seen, and whether a follower is caught_up, following or lost.

    `seen` is (server_guid, at).
    """
    own, at = fresh(log, "own", "at")
    marks = seen.select(F.col("server_guid").alias(own), F.col("at").alias(at))
    rows = log.select(server, stamp).join(sized(marks, marks.count(), 64), F.col(server) == F.col(own), "left")
    behind = rows.groupBy(F.col(server).alias("server_guid")).agg(F.count(F.when(F.col(stamp) > F.coalesce(at, F.lit(0)), 1)).alias("behind"))
    state = F.when(F.col("behind") < near, "caught_up").when(F.col("behind") > lost, "lost").otherwise("following")
    return behind.withColumn("state", state)
