"""Global order over ranges equals a sort; nearest keys equal bisection."""

import random
from bisect import bisect_left, bisect_right

from pyspark.sql import functions as F

from sortmill.operators import order, scan


def test_ranked_is_a_sort(spark):
    values = random.Random(1).sample(range(10_000), 500)
    df = spark.createDataFrame([(v,) for v in values], "k int").repartition(7)
    for asc in (True, False):
        got = order.ranked(df, F.col("k").asc() if asc else F.col("k").desc()).collect()
        assert {r.pos: r.k for r in got} == {i + 1: v for i, v in enumerate(sorted(values, reverse=not asc))}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k int")
    assert order.ranked(df, F.col("k")).count() == 0
    assert order.nearest(df, "k", df.select(F.col("k").alias("x")), "x", True, True).count() == 0
    assert [tuple(r) for r in scan.find_prev(spark.createDataFrame([(1,)], "p int"), "p", df, "k", True).collect()] == [(1, None)]


def test_nearest_against_bisection(spark):
    rng = random.Random(2)
    keys = sorted(rng.sample(range(1000), 60))
    probes = [rng.randrange(-20, 1020) for _ in range(200)] + keys[:20] + keys[:3]
    k = spark.createDataFrame([(x,) for x in keys + keys[:5]] + [(None,)], "k int").repartition(5)
    p = spark.createDataFrame([(i, x) for i, x in enumerate(probes)] + [(-1, None)], "i int, p int").repartition(3)
    at = lambda i: keys[i] if 0 <= i < len(keys) else None
    for forward, equal, want in (
        (True, True, lambda x: at(bisect_left(keys, x))),
        (True, False, lambda x: at(bisect_right(keys, x))),
        (False, True, lambda x: at(bisect_right(keys, x) - 1)),
        (False, False, lambda x: at(bisect_left(keys, x) - 1)),
    ):
        got = {r.i: r.found_key for r in order.nearest(p, "p", k, "k", forward, equal).collect()}
        assert got == {i: want(x) for i, x in enumerate(probes)} | {-1: None}


def test_previous_crosses_ranges(spark):
    df = spark.createDataFrame([(i,) for i in range(300)], "k int").repartition(9)
    got = order.with_previous(df, [F.col("k")], "k", "before").collect()
    assert {r.k: r.before for r in got} == {0: None} | {i: i - 1 for i in range(1, 300)}


def test_scan_bounds_are_inclusive_and_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(i, i * i) for i in range(20)] + [(None, 0)], "k int, v int").write.parquet(path)
    df = spark.read.parquet(path)
    assert sorted(r.k for r in scan.scan(df, "k", 5, 9, pos=None).collect()) == [5, 6, 7, 8, 9]
    assert [(r.pos, r.k) for r in scan.scan(df, "k", 5, 9, forward=False, match=F.col("v") > 30).orderBy("pos").collect()] == [(1, 9), (2, 8), (3, 7), (4, 6)]
    assert scan.scan(df, "k", pos=None).count() == 20
    plan = scan.scan(df.select("k"), "k", 5, 9, pos=None)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k,5)" in plan and "LessThanOrEqual(k,9)" in plan


def test_paging_needs_no_state(spark):
    df = spark.createDataFrame([(i,) for i in range(25)], "k int")
    seen, at = [], -1
    while batch := [r.k for r in scan.page(df, "k", at, 10, after=True).collect()]:
        seen += batch
        at = batch[-1]
    assert seen == list(range(25))


def test_fixed_ids_of_ten_digits(spark):
    from sortmill.functions import codec

    df = spark.range(0, 1000, 30).select(codec.lsd(F.col("id"), 10).alias("id"))
    for forward in (True, False):
        got = [r.id for r in scan.scan(df, "id", "0000000000", "0000000990", forward).orderBy("pos").collect()]
        assert got == sorted((f"{i:010d}" for i in range(0, 1000, 30)), reverse=not forward) and len(got) == 34


def test_rows_are_shuffled_once(spark):
    """The written ranges are read without another exchange of rows: what is left is one partial count or key for each range."""
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    keys = spark.range(50).select((F.col("id") * 7).alias("x"))
    laid = order.laid_out(df, [F.col("k")], [F.col("k")], "part", "nth")._jdf.queryExecution().executedPlan().toString()
    assert laid.count("Exchange rangepartitioning") == 1 and laid.count("Exchange ") == 1
    for got in (order.ranked(df, F.col("k")), order.with_previous(df, [F.col("k")], "k", "b"), order.nearest(df, "k", keys, "x", True, True)):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Exchange rangepartitioning" not in plan and "partial_" in plan
        assert "SortMergeJoin" not in plan


def test_columns_of_any_name_are_carried(spark):
    names = ("range", "nth", "n", "before", "prev", "last", "carried", "at", "own_key", "seen", "end", "__range", "__local", "__before", "Range")
    spark.conf.set("spark.sql.caseSensitive", "false")
    df = spark.createDataFrame([(i, i) for i in range(30)], "k int, v int").withColumns({c: F.lit(c) for c in names[:-1]})
    keys = spark.createDataFrame([(5,), (20,)], "x int")
    for got in (order.ranked(df, F.col("k")), order.with_previous(df, [F.col("k")], "k", "b"), order.nearest(df, "k", keys, "x", True, True)):
        rows = got.collect()
        assert got.columns[:-1] == df.columns and len(rows) == 30 and all(r[c] == c for r in rows for c in names[:-1])
    assert [r.pos for r in order.ranked(df.withColumn("pos", F.lit("mine")), F.col("k")).orderBy("k").collect()] == list(range(1, 31))


def test_previous_and_nearest_of_strings_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([(f"k{i:04d}",) for i in range(200)], "k string").repartition(3)
        got = {r.k: r.b for r in order.with_previous(df, [F.col("k")], "k", "b").collect()}
        assert got == {f"k{i:04d}": f"k{i - 1:04d}" if i else None for i in range(200)}
        keys = spark.createDataFrame([("k0050",), ("k0150",)], "x string")
        found = {r.k: r.found_key for r in order.nearest(df, "k", keys, "x", False, True).collect()}
        assert found == {f"k{i:04d}": None if i < 50 else "k0050" if i < 150 else "k0150" for i in range(200)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
