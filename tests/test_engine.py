"""The facade over documents, snapshots, batches and replicas."""

import pytest
from pyspark.sql import functions as F

from sortmill.engine import Engine
from sortmill.functions.ids import COUNTER_BITS, unique_ids
from sortmill.operators import versions
from sortmill.sources import updatelog


@pytest.fixture()
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path))


def test_documents(spark, engine):
    users = spark.createDataFrame([("user1", "David", 60), ("user2", "Tom", 32), ("user3", "Tom", 32)], "_id string, name string, age int")
    docs = engine.documents("users", users, "_id")
    docs.ensure_index("name")
    docs.ensure_index("age")
    assert {r._id for r in docs.find({"name": "Tom"}).collect()} == {"user2", "user3"}
    older = docs.update({"name": "Tom"}, {"$inc": {"age": 1}}).insert(spark.createDataFrame([("user4", "Ann", 1)], users.schema)).delete({"_id": "user3"})
    assert {r._id: r.age for r in older.find({}).collect()} == {"user1": 60, "user2": 33, "user4": 1}


def test_snapshots(spark, engine):
    frame = lambda *rows: spark.createDataFrame(rows, "key string, value string")
    stage = engine.snapshots(frame(("1/2/3", "a"), ("1/3/4", "b"), ("1/5/3", "c")), ["key"])
    stage, first = stage.take()
    stage = stage.write(frame(("1/2/3", "new"))).write(frame(("1/2/3", "newer"))).delete(frame(("1/5/3", "")))
    read = lambda s: {r.key: r.value for r in s.read().collect()}
    assert read(stage) == {"1/2/3": "newer", "1/3/4": "b"}
    assert read(stage.at(first)) == {"1/2/3": "a", "1/3/4": "b", "1/5/3": "c"}
    with pytest.raises(versions.Frozen):
        stage.at(first).write(frame(("x", "y")))


def test_batches_and_raw_records(spark, engine):
    frame = lambda *rows: spark.createDataFrame(rows, "key string, value string")
    engine.write("kv", 0, ["key"], frame(("a", "1"), ("b", "1")))
    engine.write("kv", 1, ["key"], frame(("c", "2")), frame(("a", "")))
    engine.write("kv", 2, ["key"], deletes=frame(("zz", "")))
    assert {r.key: r.value for r in engine.get("kv", ["key"]).collect()} == {"b": "1", "c": "2"}
    held = updatelog.record_update(updatelog.read(spark, engine.log("kv")), {"key": "a"}).collect()
    assert {(r.gen, r.update_type) for r in held} == {(0, "FULL"), (1, "DELETION_TOMBSTONE")}


def test_replicas(spark, engine):
    log = spark.createDataFrame([("a", 1, "k")], "server string, logstamp bigint, key string")
    one = engine.replica(log, ["key"], instance="i")
    two = one.append(spark.createDataFrame([("a", 1, "l")], log.schema))
    assert [(r.g, r.action) for r in one.actions(two).collect()] == [("a", "replay")] and [r.action for r in two.actions(one).collect()] == ["resolve"]
    with pytest.raises(ValueError):
        one.actions(engine.replica(log, ["key"], instance="j"))


def test_cell_mutations(spark):
    cells = spark.createDataFrame([("r", "c", 1, "x"), ("r", "c", 3, "y"), ("r", "d", 1, "z")], "row string, col string, ver int, value string")
    batch = spark.createDataFrame([("r", "c", 2, None, True), ("r", "e", 5, "new", False)], "row string, col string, ver int, value string, deleted boolean")
    got = versions.mutate_rows(cells, batch, "row", "col", "ver")
    assert {(r.col, r.ver) for r in got.collect()} == {("c", 3), ("d", 1), ("e", 5)}


def test_ids_ascend(spark):
    df = spark.range(100).withColumn("k", F.col("id") * 7 % 100).drop("id").repartition(4)
    one = {r.k: r.id for r in unique_ids(df, F.col("k"), second=1000).collect()}
    two = {r.k: r.id for r in unique_ids(df, F.col("k"), second=1001).collect()}
    assert [one[k] for k in sorted(one)] == sorted(set(one.values())) and max(one.values()) < min(two.values()) and min(one.values()) > 1000 << COUNTER_BITS
