"""Merging, compaction and versions against a dictionary; the planner against worked examples."""

import random

import pytest
from pyspark.sql import functions as F

from sortmill.operators import lsm, versions
from sortmill.operators.lsm import Segment
from sortmill.sources import updatelog


def log_rows(seed, n=400):
    rng = random.Random(seed)
    return [(f"k{rng.randrange(40)}", rng.randrange(4), i, rng.choice(["FULL", "FULL", "DELETION_TOMBSTONE", "NONE"]), f"v{i}") for i in range(n)]


SCHEMA = "key string, gen int, seq int, update_type string, value string"


def model(rows, deleted=False):
    best = {}
    for key, gen, seq, kind, value in rows:
        if kind != "NONE" and (key not in best or (gen, seq) > best[key][:2]):
            best[key] = (gen, seq, kind, value)
    return {k: (kind, v) for k, (_, _, kind, v) in best.items() if deleted or kind == "FULL"}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merge_read(spark, seed):
    rows = log_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.key: (r.update_type, r.value) for r in lsm.merge_read(df, ["key"], ["gen", "seq"]).collect()}
    assert got == model(rows)


def test_compaction_keeps_tombstones_above_the_base(spark):
    rows = [r for r in log_rows(4) if r[1] > 0]
    df = spark.createDataFrame(rows, SCHEMA)
    got = lsm.compact(df, ["key"], ["gen", "seq"]).collect()
    assert {r.key: (r.update_type, r.value) for r in got} == model(rows, deleted=True) and {r.target_gen for r in got} == {1}
    low = lsm.compact(spark.createDataFrame(log_rows(4), SCHEMA), ["key"], ["gen", "seq"]).collect()
    assert {r.key: (r.update_type, r.value) for r in low} == model(log_rows(4))


def test_partial_updates_are_an_error(spark):
    df = spark.createDataFrame([("a", 0, 0, "PARTIAL", "x")], SCHEMA)
    with pytest.raises(Exception, match="PARTIAL"):
        lsm.merge_read(df, ["key"], ["seq"]).collect()


def test_empty_log(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert lsm.merge_read(df, ["key"], ["gen"]).count() == lsm.compact(df, ["key"], ["gen"]).count() == 0


def test_update_log_on_disk(spark, tmp_path):
    rows, path = log_rows(5), str(tmp_path / "log")
    df = spark.createDataFrame(rows, SCHEMA)
    for gen in range(4):
        for _ in range(2):  # a repeated write of a generation changes nothing
            updatelog.append(df.filter((F.col("gen") == gen) & (F.col("update_type") != "NONE")), path, gen, ["key"], ["seq"])
    want = model(rows)
    assert {r.key: (r.update_type, r.value) for r in updatelog.read_merged(spark, path, ["key"]).collect()} == want
    updatelog.compact_to(spark, path, ["key"], str(tmp_path / "compacted"))
    assert {r.key: (r.update_type, r.value) for r in updatelog.read(spark, str(tmp_path / "compacted")).collect()} == want


def test_merge_and_intersect_examples(spark):
    one = spark.createDataFrame([(k, f"a{k}") for k in (1, 3, 5, 7)], "k int, v string")
    two = spark.createDataFrame([(k, f"b{k}") for k in (2, 4, 7, 9, 10)], "k int, v string")
    merged = lsm.merge_sorted(one, two, ["k"]).orderBy("pos").collect()
    assert [(r.pos, r.k, r.src) for r in merged] == list(zip(range(1, 10), (1, 2, 3, 4, 5, 7, 7, 9, 10), ("one", "two", "one", "two", "one", "one", "two", "two", "two")))
    assert [r.k for r in lsm.merge_sorted(one, two, ["k"], True, forward=False).orderBy("pos").collect()] == [10, 9, 7, 5, 4, 3, 2, 1]
    left = {r.k: (r.v, r.src) for r in lsm.merge_sorted(one, two, ["k"], left_wins=True).collect()}
    assert sorted(left) == [1, 2, 3, 4, 5, 7, 9, 10] and left[7] == ("a7", "one")
    a = spark.createDataFrame([(k, str(k)) for k in (0, 2, 5, 7, 10)], "k int, v string")
    b = spark.createDataFrame([(k, str(k)) for k in range(1, 10)], "k int, v string")
    for x, y in ((a, b), (b, a)):
        assert sorted(r.k for r in lsm.intersect_sorted(x, y, "k", "v", "v").collect()) == [2, 5, 7]


def test_ascending_check(spark):
    df = spark.createDataFrame([(i, k) for i, k in enumerate([1, 2, 2, 5, 4, 6])], "i int, k int")
    assert tuple(lsm.check_ascending(df, ["i"], "k").first()) == (1, 1)


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(3), i, lo := rng.randrange(-200, 1000), lo + rng.randrange(0, 120)) for i in range(80)]
    df = spark.createDataFrame(rows, "gen int, slot int, lo int, hi int")
    want = {(a[0], a[1], b[0], b[1]) for a in rows for b in rows if a[0] > b[0] and a[2] <= b[3] and a[3] >= b[2]}
    for cells in (1, 7, 500):
        got = [(r.gen, r.slot, r.t_gen, r.t_slot) for r in lsm.overlap_join(df, df, "lo", "hi", cells).filter("gen > t_gen").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert set(map(tuple, lsm.segment_overlap(df).collect())) == want
    ranges = spark.createDataFrame([(0, 5000, 6000), (1, -100, 900)], "pid int, lo int, hi int")
    assert {r.pid: r.safe_gen for r in lsm.min_safe_generation(ranges, "pid", df).collect()} == {0: 0, 1: 3}


def test_overlaps_of_string_keys(spark):
    rows = [(0, "test/rnd/306608504", "test/rnd/653566822"), (1, "test/rnd/328202073", "test/rnd/669936319"), (2, "test/rnd/328202073", "test/rnd/996219212"), (3, "test/rnd/728202073", "test/rnd/996219212"), (4, "a", "zzz"), (5, None, "z"), (6, "b", None)]
    df = spark.createDataFrame(rows, "i int, lo string, hi string")
    want = {(a[0], b[0]) for a in rows[:5] for b in rows[:5] if a[1] <= b[2] and a[2] >= b[1]}
    for cells in (1, 3, 128):
        got = [(r.i, r.t_i) for r in lsm.overlap_join(df, df, "lo", "hi", cells).collect()]
        assert len(got) == len(want) and set(got) == want
    assert (0, 3) not in want and (0, 1) in want and (2, 3) in want
    assert lsm.overlap_join(df.limit(0), df.limit(0), "lo", "hi").count() == 0


def test_a_range_over_everything_is_listed_under_few_cells(spark):
    df = spark.createDataFrame([(i, i * 10, i * 10 + 5) for i in range(500)] + [(999, 0, 10**15)], "i int, lo bigint, hi bigint")
    got = lsm.overlap_join(df.filter("i = 999"), df, "lo", "hi", 16)
    assert got.count() == 501


def test_segment_lists_and_maintenance(spark):
    a = spark.createDataFrame([(0, "A", "B"), (1, "C", "D"), (1, "C", "D")], "gen int, lo string, hi string")
    b = spark.createDataFrame([(0, "A", "B"), (1, "C", "D"), (2, "E", None)], "gen int, lo string, hi string")
    keys = ["gen", "lo", "hi"]
    assert {(r.gen, r.state) for r in lsm.compare_segments(a, b, keys).collect()} == {(1, "times"), (2, "unlisted")}
    assert {(r.gen, r.state) for r in lsm.compare_segments(b, a, keys).collect()} == {(1, "times"), (2, "missing")}
    lsm.verify_segments(a, a, keys)
    with pytest.raises(ValueError):
        lsm.verify_segments(a, b, keys)
    assert lsm.relevant_segments(a, 1, "A", "Z", 1) is None and lsm.relevant_segments(a, 0, "A", "Z", 1).count() == 1
    due = spark.createDataFrame([(0.5, 0), (0.29, 0), (0.9, 16 * 512 * 1024)], "free double, held bigint")
    assert [r[0] for r in due.select(lsm.wants_flush(F.col("free"), F.col("held"))).collect()] == [False, True, True]
    scores = spark.createDataFrame([(1.6, 0), (1.61, 0), (2.1, 6), (2.11, 6)], "score double, max_gen int")
    assert [r[0] for r in scores.select(lsm.worth_merging(F.col("score"), F.col("max_gen"))).collect()] == [True, False, True, False]


def test_planner_examples():
    g0, g1, g2 = (Segment(g, "A", "Z") for g in range(3))
    many = {"smallest": 1, "largest": 1000}
    assert [(c.sources, c.targets) for c in lsm.merge_candidates([g0, g1], **many)] == [((g1,), (g0,))]
    three = lsm.merge_candidates([g0, g1, g2], **many)
    assert len(three) == 3 and (three[0].sources, three[0].targets) == ((g2, g1), (g0,))
    ab, df, ac, az = Segment(0, "A", "B"), Segment(0, "D", "F"), Segment(1, "A", "C"), Segment(2, "A", "Z")
    assert lsm.merge_candidates([ab, df], **many) == []
    assert [(c.sources, c.targets) for c in lsm.merge_candidates([ab, df, ac], **many)] == [((ac,), (ab,))]
    best = lsm.merge_candidates([ab, df, ac, az], **many)
    assert len(best) == 3 and (best[0].sources, best[0].targets) == ((az, ac), (ab, df))
    assert lsm.merge_candidates([g0, g1, g2]) == []  # fewer than the usual least size


def test_snapshots(spark):
    rows = [("b/1", 0, "DELETION_TOMBSTONE", "x"), ("a/1", 0, "FULL", "y"), ("a/1", 1, "DELETION_TOMBSTONE", None), ("c", 1, "FULL", "late")]
    df = spark.createDataFrame(rows, "key string, version int, update_type string, value string")
    read = lambda d: sorted((r.key, r.value) for r in d.collect())
    assert versions.frozen(df, "version") == 1
    assert read(versions.snapshot(df, ["key"], ["version"])) == [("c", "late")]
    assert read(versions.snapshot(df, ["key"], ["version"], F.col("version") <= 0)) == [("a/1", "y")]
    # in the other kind of store a deletion hides nothing
    assert read(versions.timestamp_snapshot(df, ["key"], ["version"])) == [("a/1", "y"), ("c", "late")]


def test_one_row_per_key_whatever_is_invisible(spark):
    rows = [("a", 5, "FULL", "new"), ("b", 1, "FULL", "b1"), ("b", 2, "FULL", "b2"), ("b", 9, "FULL", "b9")]
    df = spark.createDataFrame(rows, "key string, version int, update_type string, value string")
    got = versions.snapshot(df, ["key"], ["version"], F.col("version") <= 3).collect()
    assert [(r.key, r.value) for r in got] == [("b", "b2")]
    bounded = versions.snapshot(df.filter(F.col("key") <= "b"), ["key"], ["version"]).collect()
    assert sorted(r.key for r in bounded) == ["a", "b"]  # the bound is a user key, and included


def test_namespaces_do_not_mix(spark):
    rows = [(ns, k, f"{ns}:{k}") for ns in ("stage1", "stage2") for k in ("1/2/3", "1/3/4", "1/5/3")]
    df = spark.createDataFrame(rows, "ns string, key string, value string")
    for ns in ("stage1", "stage2"):
        got = versions.namespace(df, ns).collect()
        assert len(got) == 3 and all(r.value.startswith(ns) for r in got)
