"""Every query by name, and the SQL that states its result.

`events` serves as an update log: its key is (user_id, k), `k` and `gen` are made of the event's number, and an event of type `error`
is a deletion. The number of the event orders updates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortmill.functions import codec, ids
from sortmill.operators import documents, keys, lsm, pipes, replog, scan, textindex, versions
from sortmill.operators.order import ranked
from sortmill.shared import fresh_path, sized, table
from sortmill.sources import updatelog
from sortmill.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# ---- scans of keys

LOW, HIGH = 100, 1_000_000_000


@query(f"SELECT row_number() OVER (ORDER BY o_orderkey) AS pos, o_orderkey FROM orders WHERE o_orderkey BETWEEN {LOW} AND {HIGH}")
def kv_scan_forward(spark, d):
    return scan.scan(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", LOW, HIGH).select("pos", "o_orderkey")


@query(f"SELECT row_number() OVER (ORDER BY o_orderkey DESC) AS pos, o_orderkey FROM orders WHERE o_orderkey BETWEEN {LOW} AND {HIGH}")
def kv_scan_backward(spark, d):
    return scan.scan(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", LOW, HIGH, forward=False).select("pos", "o_orderkey")


@query(f"SELECT row_number() OVER (ORDER BY o_orderkey) AS pos, o_orderkey FROM orders WHERE o_orderkey BETWEEN {LOW} AND {HIGH} AND o_orderstatus = 'F'")
def kv_scan_residual(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return scan.scan(rows, "o_orderkey", LOW, HIGH, match=F.col("o_orderstatus") == "F").select("pos", "o_orderkey")


@query("SELECT row_number() OVER (ORDER BY c_custkey) AS pos, c_custkey, c_name FROM customer")
def kv_scan_all(spark, d):
    return scan.scan(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey").select("pos", "c_custkey", "c_name")


def _asof(op: str) -> str:
    return f"SELECT o_orderkey AS probe, k AS found_key FROM orders ASOF JOIN (SELECT p_partkey * 7 AS k FROM part) p ON o_orderkey {op} k"


def _probe(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("probe")), table(spark, d, "part").select((F.col("p_partkey") * 7).alias("k"))


@query(_asof("<="))
def kv_find_next_incl(spark, d):
    probes, held = _probe(spark, d)
    return scan.find_next(probes, "probe", held, "k", True).filter("found_key IS NOT NULL")


@query(_asof("<"))
def kv_find_next_excl(spark, d):
    probes, held = _probe(spark, d)
    return scan.find_next(probes, "probe", held, "k", False).filter("found_key IS NOT NULL")


@query(_asof(">="))
def kv_find_prev_incl(spark, d):
    probes, held = _probe(spark, d)
    return scan.find_prev(probes, "probe", held, "k", True).filter("found_key IS NOT NULL")


@query(_asof(">"))
def kv_find_prev_excl(spark, d):
    probes, held = _probe(spark, d)
    return scan.find_prev(probes, "probe", held, "k", False).filter("found_key IS NOT NULL")


@query("SELECT c_custkey * 2 AS probe, CASE WHEN s_suppkey IS NULL THEN 'MISSING' ELSE 'PRESENT' END AS status, s_name FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey * 2")
def kv_get_record(spark, d):
    probes = table(spark, d, "customer").select((F.col("c_custkey") * 2).alias("probe"))
    return scan.get_records(probes, "probe", table(spark, d, "supplier"), "s_suppkey", "s_name")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def kv_prefix_scan(spark, d):
    prefixes = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return scan.prefix_scan(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), prefixes, ["l_orderkey"])


@query("SELECT c_custkey, c_mktsegment, c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def kv_prefix_scan_encoded(spark, d):
    """The same over one binary key of mixed parts: a range of that key."""
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    key = keys.encode(keys.string_part(F.col("c_mktsegment")), keys.long_part(F.col("c_nationkey")), keys.long_part(F.col("c_custkey")))
    return rows.withColumn("key", key).filter(keys.in_prefix(F.col("key"), keys.string_part(F.lit("BUILDING")))).drop("key")


@query("SELECT row_number() OVER (ORDER BY subtype, l, s) AS pos, subtype, l, s FROM (SELECT 1 AS subtype, c_custkey AS l, '' AS s FROM customer UNION ALL SELECT 2, CAST(0 AS BIGINT), n_name FROM nation) t")
def key_typed_sort(spark, d):
    longs = table(spark, d, "customer").select(F.lit(1).alias("subtype"), F.col("c_custkey").alias("l"), F.lit("").alias("s"))
    strings = table(spark, d, "nation").select(F.lit(2).alias("subtype"), F.lit(0).cast("bigint").alias("l"), F.col("n_name").alias("s"))
    key = F.when(F.col("subtype") == 1, keys.long_part(F.col("l"))).otherwise(keys.string_part(F.col("s")))
    return ranked(longs.unionByName(strings).withColumn("key", key), F.col("key")).select("pos", "subtype", "l", "s")


@query("SELECT p_partkey, p_brand AS part1, p_type AS part2, CAST(2 AS BIGINT) AS parts FROM part")
def key_parse(spark, d):
    parts = keys.parse(F.concat_ws("/", "p_brand", "p_type"))
    held = table(spark, d, "part").select("p_partkey", parts.alias("key"))
    return held.select("p_partkey", F.element_at("key", 1).alias("part1"), F.element_at("key", 2).alias("part2"), F.size("key").cast("bigint").alias("parts"))


@query("SELECT n_nationkey, (CAST(1000 AS BIGINT) << 24) + row_number() OVER (ORDER BY n_nationkey) AS id FROM nation")
def unique_ids(spark, d):
    return ids.unique_ids(table(spark, d, "nation").select("n_nationkey"), F.col("n_nationkey"), second=1000)


@query("SELECT p_partkey, p_type, p_brand FROM part WHERE p_type = 'STANDARD'")
def key_is_subkey_of(spark, d):
    parts = F.array("p_type", "p_brand", F.col("p_partkey").cast("string"))
    return table(spark, d, "part").filter(keys.is_subkey_of(parts, F.array(F.lit("STANDARD")))).select("p_partkey", "p_type", "p_brand")


@query("SELECT row_number() OVER (ORDER BY k) AS pos, k, v FROM (SELECT 'stage1' AS ns, s_suppkey AS k, s_name AS v FROM supplier UNION ALL SELECT 'stage2', c_custkey, c_name FROM customer) t WHERE ns = 'stage2'")
def subset_namespace(spark, d):
    one = table(spark, d, "supplier").select(F.lit("stage1").alias("ns"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    two = table(spark, d, "customer").select(F.lit("stage2").alias("ns"), F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    return scan.scan(versions.namespace(one.unionByName(two), "stage2"), "k").select("pos", "k", "v")


# ---- update logs


def updates(spark: SparkSession, d: str, *more: str) -> DataFrame:
    events = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", lsm.TOMBSTONE).otherwise(lsm.FULL)
    return events.select("user_id", (F.col("event_id") % 10).alias("k"), (F.col("event_id") % 3).alias("gen"), "event_id", kind.alias("update_type"), *more)


_KEY = ["user_id", "k"]
_SEG = "seg AS (SELECT user_id, event_id % 10 AS k, event_id % 3{plus} AS gen, max(event_id) AS event_id FROM events GROUP BY ALL), newest AS (SELECT * FROM seg QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY gen DESC) = 1)"


@query("SELECT user_id, event_id % 10 AS k, max(event_id) AS event_id FROM events GROUP BY user_id, event_id % 10")
def lsm_memtable(spark, d):
    return lsm.newest_wins(updates(spark, d), _KEY, ["event_id"]).select("user_id", "k", "event_id")


@query(f"WITH {_SEG.format(plus='')} SELECT n.user_id, n.k, n.gen, n.event_id, e.value FROM newest n JOIN events e ON e.event_id = n.event_id WHERE e.event_type <> 'error'")
def lsm_merge_read(spark, d):
    return lsm.merge_read(updates(spark, d, "value"), _KEY, ["gen", "event_id"]).select("user_id", "k", "gen", "event_id", "value")


@query(f"WITH {_SEG.format(plus=' + 1')} SELECT n.user_id, n.k, n.event_id, CASE WHEN e.event_type = 'error' THEN 'DELETION_TOMBSTONE' ELSE 'FULL' END AS update_type, CAST(1 AS BIGINT) AS target_gen FROM newest n JOIN events e ON e.event_id = n.event_id")
def lsm_compact_keep_tombstones(spark, d):
    log = updates(spark, d).withColumn("gen", F.col("gen") + 1)
    return lsm.compact(log, _KEY, ["gen", "event_id"]).select("user_id", "k", "event_id", "update_type", "target_gen")


@query(f"WITH {_SEG.format(plus='')} SELECT n.user_id, n.k, n.event_id, CAST(0 AS BIGINT) AS target_gen FROM newest n JOIN events e ON e.event_id = n.event_id WHERE e.event_type <> 'error'")
def lsm_compact_to_base(spark, d):
    return lsm.compact(updates(spark, d), _KEY, ["gen", "event_id"]).select("user_id", "k", "event_id", "target_gen")


def _two(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v")), table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))


_BOTH = "(SELECT s_suppkey AS k, s_name AS v, 'one' AS src FROM supplier UNION ALL SELECT c_custkey, c_name, 'two' FROM customer) t"


@query(f"SELECT row_number() OVER (ORDER BY k, src) AS pos, k, v, src FROM {_BOTH}")
def sorted_merge_all(spark, d):
    return lsm.merge_sorted(*_two(spark, d), ["k"])


@query(f"SELECT row_number() OVER (ORDER BY k) AS pos, k, arg_min(v, src) AS v, min(src) AS src FROM {_BOTH} GROUP BY k")
def sorted_merge_left_wins(spark, d):
    return lsm.merge_sorted(*_two(spark, d), ["k"], left_wins=True)


@query("SELECT s_suppkey AS k, s_name AS v1, c_name AS v2 FROM supplier JOIN customer ON s_suppkey = c_custkey")
def sorted_intersect(spark, d):
    return lsm.intersect_sorted(table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("one")), table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("two")), "key", "one", "two")


@query("SELECT count(CASE WHEN prev = k THEN 1 END) AS dup_adjacent, count(CASE WHEN prev > k THEN 1 END) AS non_ascending FROM (SELECT l_orderkey AS k, lag(l_orderkey) OVER (ORDER BY l_orderkey, l_linenumber) AS prev FROM lineitem) t")
def check_ascending(spark, d):
    return lsm.check_ascending(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], "l_orderkey")


@query("SELECT seg, min(o_orderkey) AS start_key, max(o_orderkey) AS end_key, count(*) AS key_count FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) - (row_number() OVER (ORDER BY o_orderkey) - 1) % 500 AS seg FROM orders) t GROUP BY seg")
def segment_index(spark, d):
    return lsm.segment_index(table(spark, d, "orders"), "o_orderkey", 500)


SPAN, PLANNED = 700, 200


def _segments(spark, d):
    log = table(spark, d, "events").select("event_id", (F.col("event_id") % 3).alias("gen"), F.floor(F.col("event_id") / SPAN).cast("bigint").alias("slot"))
    return log.groupBy("gen", "slot").agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))


_SEGMENTS = f"s AS (SELECT event_id % 3 AS gen, event_id // {SPAN} AS slot, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY ALL)"


@query(f"WITH {_SEGMENTS} SELECT a.gen AS src_gen, a.slot AS src_slot, b.gen AS tgt_gen, b.slot AS tgt_slot FROM s a JOIN s b ON a.gen > b.gen AND a.lo <= b.hi AND a.hi >= b.lo")
def segment_overlap(spark, d):
    return lsm.segment_overlap(_segments(spark, d))


@query(f"WITH {_SEGMENTS}, t AS (SELECT gen, slot, 'test/rnd/' || lpad(lo::VARCHAR, 9, '0') AS lo, 'test/rnd/' || lpad(hi::VARCHAR, 9, '0') AS hi FROM s) SELECT a.gen AS src_gen, a.slot AS src_slot, b.gen AS tgt_gen, b.slot AS tgt_slot FROM t a JOIN t b ON a.gen > b.gen AND a.lo <= b.hi AND a.hi >= b.lo")
def segment_overlap_strings(spark, d):
    named = lambda c: F.concat(F.lit("test/rnd/"), F.lpad(F.col(c).cast("string"), 9, "0")).alias(c)
    return lsm.segment_overlap(_segments(spark, d).select("gen", "slot", named("lo"), named("hi")))


@query("SELECT gen, slot, CASE WHEN slot % 5 = 0 THEN 'missing' ELSE 'unlisted' END AS state FROM (SELECT DISTINCT event_id % 3 AS gen, event_id // 700 AS slot FROM events) t WHERE slot % 5 = 0 OR slot % 7 = 0 AND slot % 5 <> 0")
def segment_verify(spark, d):
    listed, found = _segments(spark, d).filter("slot % 7 <> 0 OR slot % 5 = 0"), _segments(spark, d).filter("slot % 5 <> 0")
    return lsm.compare_segments(listed, found, ["gen", "slot"])


@query(f"WITH {_SEGMENTS}, p AS (SELECT s_suppkey AS pid, s_suppkey * 131 AS lo, s_suppkey * 131 + 40 AS hi FROM supplier) SELECT pid, coalesce(max(s.gen) + 1, 0) AS safe_gen FROM p LEFT JOIN s ON p.lo <= s.hi AND p.hi >= s.lo GROUP BY pid")
def min_safe_generation(spark, d):
    at = F.col("s_suppkey") * 131
    ranges = table(spark, d, "supplier").select(F.col("s_suppkey").alias("pid"), at.alias("lo"), (at + 40).alias("hi"))
    return lsm.min_safe_generation(ranges, "pid", _segments(spark, d))


@query("WITH c AS (SELECT s_suppkey AS id, s_suppkey % 4 + 1 AS n_src, s_suppkey % 7 + 1 AS n_tgt, s_suppkey % 6 + 1 AS hi_gen, s_suppkey % 2 AS lo_gen FROM supplier) SELECT id, CAST(n_tgt AS DOUBLE) / n_src - CAST(0.02 AS DOUBLE) * hi_gen - CAST(0.003 AS DOUBLE) * (n_src + n_tgt) - CAST(0.03 AS DOUBLE) * (hi_gen - lo_gen) AS score FROM c")
def merge_candidate_score(spark, d):
    n = F.col("s_suppkey")
    return table(spark, d, "supplier").select(n.alias("id"), lsm.candidate_score(n % 4 + 1, n % 7 + 1, n % 6 + 1, n % 2).alias("score"))


@query("WITH c AS (SELECT s_suppkey AS id, CAST((s_suppkey % 90) / CAST(40 AS DOUBLE) AS DOUBLE) AS score, s_suppkey % 6 AS max_gen FROM supplier) SELECT id FROM c WHERE score <= CAST(1.6 AS DOUBLE) + max_gen / CAST(12 AS DOUBLE)")
def merge_worth(spark, d):
    n = F.col("s_suppkey")
    return table(spark, d, "supplier").filter(lsm.worth_merging(n % 90 / F.lit(40.0), n % 6)).select(n.alias("id"))


@query()
def merge_candidates(spark, d):
    """The planner works on the list of segments: metadata, of one row for each PLANNED keys at least, more in higher generations."""
    log = table(spark, d, "events").select("event_id", (F.col("event_id") % 3).alias("gen"))
    held = log.groupBy("gen", F.floor(F.col("event_id") / (PLANNED * (1 + F.col("gen"))))).agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    rows = [lsm.Segment(r.gen, f"{r.lo:019d}", f"{r.hi:019d}") for r in held.collect()]
    made = [(i, c.score, c.n_src, c.n_tgt, c.sources[0].lo, c.targets[-1].hi) for i, c in enumerate(lsm.merge_candidates(rows))]
    return spark.createDataFrame(made, "rank_pos int, score double, n_src int, n_tgt int, first_key string, last_key string")


# ---- versions

AS_OF = "2024-01-15 00:00:00"
_NEWEST = "SELECT user_id, k, event_id, value FROM (SELECT user_id, event_id % 10 AS k, event_id, value, event_type, row_number() OVER (PARTITION BY user_id, event_id % 10 ORDER BY event_id DESC) AS rn FROM events{where}) t WHERE rn = 1 AND event_type <> 'error'"


@query(_NEWEST.format(where=""))
def snapshot_current(spark, d):
    return versions.snapshot(updates(spark, d, "value"), _KEY, ["event_id"]).select("user_id", "k", "event_id", "value")


@query(_NEWEST.format(where=f" WHERE ts <= TIMESTAMP '{AS_OF}'"))
def snapshot_as_of(spark, d):
    until = F.col("ts") <= F.lit(AS_OF).cast("timestamp_ntz")
    return versions.snapshot(updates(spark, d, "value", "ts"), _KEY, ["event_id"], until).select("user_id", "k", "event_id", "value")


@query(f"SELECT user_id, event_id % 10 AS k, max(event_id) AS event_id FROM events WHERE ts <= TIMESTAMP '{AS_OF}' AND event_type <> 'error' GROUP BY user_id, event_id % 10")
def timestamp_snapshot_as_of(spark, d):
    until = F.col("ts") <= F.lit(AS_OF).cast("timestamp_ntz")
    return versions.timestamp_snapshot(updates(spark, d, "ts"), _KEY, ["event_id"], until).select("user_id", "k", "event_id")


_STAGED = "SELECT c_custkey AS k, {v} AS v FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey{where}"


def _stage(spark, d):
    """A stage with the customers; a snapshot; then suppliers written over some of them, and every seventh deleted."""
    first = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    blank = first.limit(0).withColumn("update_type", F.lit(lsm.FULL)).withColumn("version", F.lit(0))
    stage, number = versions.SnapshotStage(blank, ["k"]).write(first).take()
    over = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v")).join(first.select("k"), "k", "left_semi")
    return stage.write(over).delete(first.filter("k % 7 = 0")), number


@query(_STAGED.format(v="coalesce(s_name, c_name)", where=" WHERE c_custkey % 7 <> 0"))
def snapshot_stage_current(spark, d):
    return _stage(spark, d)[0].read().select("k", "v")


@query(_STAGED.format(v="c_name", where=""))
def snapshot_stage_frozen(spark, d):
    stage, number = _stage(spark, d)
    return stage.at(number).read().select("k", "v")


@query("WITH gone AS (SELECT user_id, event_type, max(event_id) AS upto FROM events WHERE event_id % 97 = 0 GROUP BY ALL) SELECT e.user_id, e.event_type, e.event_id, e.value FROM events e LEFT JOIN gone g ON e.user_id = g.user_id AND e.event_type = g.event_type WHERE upto IS NULL OR e.event_id > upto UNION ALL SELECT user_id, event_type, event_id + 1000000, value FROM events WHERE event_id % 89 = 0")
def cell_mutate(spark, d):
    cells = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    gone = cells.filter("event_id % 97 = 0").withColumn("value", F.lit(None).cast("double")).withColumn("deleted", F.lit(True))
    new = cells.filter("event_id % 89 = 0").withColumn("event_id", F.col("event_id") + 1000000).withColumn("deleted", F.lit(False))
    return versions.mutate_rows(cells, gone.unionByName(new), "user_id", "event_type", "event_id")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) t WHERE rn <= 3")
def cell_versions(spark, d):
    return versions.cell_versions(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id", 3)


@query("SELECT user_id, string_agg(event_type || '=' || event_id, ',' ORDER BY event_type) AS cells FROM (SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL) t GROUP BY user_id")
def row_cells(spark, d):
    rows = versions.row_maps(table(spark, d, "events").withColumn("cell", F.col("event_id")), "user_id", "event_type", "event_id", "cell")
    text = F.transform(F.map_entries("cells"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return rows.select("user_id", F.array_join(F.array_sort(text), ",").alias("cells"))


@query("SELECT user_id, count(DISTINCT event_type) AS column_count FROM events GROUP BY user_id")
def slice_count(spark, d):
    return versions.slice_count(table(spark, d, "events"), "user_id", "event_type")


@query("SELECT user_id, event_type, event_id FROM (SELECT user_id, event_type, max(event_id) AS event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type DESC) AS rn FROM events WHERE event_type <= 'signup' AND event_type >= 'error' GROUP BY user_id, event_type) t WHERE rn <= 2")
def slice_columns(spark, d):
    cells = versions.cell_versions(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id", 1)
    return versions.slice_columns(cells, "user_id", "event_type", start="signup", finish="error", reverse=True, count=2)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 500 ORDER BY o_orderkey LIMIT 100")
def range_slices(spark, d):
    return scan.page(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 500, 100)


@query("SELECT user_id, event_type, count(*) AS counter FROM events GROUP BY user_id, event_type")
def counter_increment(spark, d):
    return versions.counters(table(spark, d, "events"), ["user_id", "event_type"], F.lit(1).cast("bigint"))


@query("SELECT e.user_id, e.event_type, e.event_id FROM events e LEFT JOIN (SELECT user_id, max(event_id) AS upto FROM events WHERE event_type = 'error' GROUP BY user_id) x ON e.user_id = x.user_id WHERE upto IS NULL OR event_id > upto")
def delete_cells_upto(spark, d):
    cells = table(spark, d, "events").select("user_id", "event_type", "event_id")
    doomed = cells.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("upto"))
    return versions.delete_cells(cells, doomed, ["user_id"], "event_id", "upto").select("user_id", "event_type", "event_id")


# ---- documents

_WANTED = {"c_mktsegment": "BUILDING", "c_nationkey": 5}


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 5")
def doc_find(spark, d):
    return documents.find(table(spark, d, "customer"), _WANTED).select("c_custkey", "c_name", "c_acctbal")


@query("WITH idx AS (SELECT c_mktsegment AS part1, c_custkey AS pk FROM customer) SELECT c_custkey, c_name, c_acctbal FROM idx JOIN customer ON c_custkey = pk WHERE part1 = 'BUILDING' AND c_mktsegment = 'BUILDING' AND c_nationkey = 5")
def doc_find_via_index(spark, d):
    docs = table(spark, d, "customer")
    index = documents.index_entries(docs, ["c_mktsegment"], "c_custkey")
    return documents.find_via_index(docs, index, ["c_mktsegment"], "c_custkey", _WANTED).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 5")
def doc_find_best(spark, d):
    """By way of whichever stored index serves the query best: that of segment and nation."""
    docs, made = table(spark, d, "customer"), {}
    for fields in (("c_mktsegment",), ("c_mktsegment", "c_nationkey"), ("c_name",)):
        path = fresh_path(spark, "index")
        documents.ensure_index(docs, list(fields), "c_custkey", path)
        made[fields] = spark.read.parquet(path)
    return documents.find_best(docs, _WANTED, "c_custkey", made).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey * 3 FROM supplier) UNION ALL SELECT s_suppkey * 3, s_name FROM supplier")
def doc_insert(spark, d):
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = table(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("id"), F.col("s_name").alias("name"))
    return documents.insert(docs, new, "id")


@query("SELECT c_custkey AS k, CASE WHEN s_suppkey IS NULL THEN c_name ELSE s_name END AS v FROM customer LEFT JOIN supplier ON s_suppkey * 2 = c_custkey WHERE c_custkey % 5 <> 0")
def kv_multi_write(spark, d):
    """Batches of rows to set and keys to delete, written as generations of an update log, then read."""
    path = fresh_path(spark, "multi")
    first = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    second = table(spark, d, "supplier").select((F.col("s_suppkey") * 2).alias("k"), F.col("s_name").alias("v")).filter("k % 5 <> 0").join(first.select("k"), "k", "left_semi")
    for gen, batch in enumerate((updatelog.batch(first, None, ["k"]), updatelog.batch(second, first.select("k").filter("k % 5 = 0"), ["k"]))):
        updatelog.append(batch, path, gen, ["k"], ["update_type"])
    return updatelog.read_merged(spark, path, ["k"]).select("k", "v")


@query("SELECT 'c_mktsegment' AS index_name, c_mktsegment AS part1, c_custkey AS pk FROM customer")
def doc_index_entries(spark, d):
    return documents.index_entries(table(spark, d, "customer"), ["c_mktsegment"], "c_custkey")


@query("SELECT index_name, score, row_number() OVER (ORDER BY score DESC, index_id DESC) AS rank_pos FROM (SELECT 0 AS index_id, '_id' AS index_name, CAST(0.1 AS DOUBLE) AS score UNION ALL SELECT 1, 'c_mktsegment', CAST(1.0 AS DOUBLE) UNION ALL SELECT 2, 'c_mktsegment,c_nationkey', CAST(2.0 AS DOUBLE)) t")
def doc_index_score(spark, d):
    ranks = documents.rank_indexes(_WANTED, [["_id"], ["c_mktsegment"], ["c_mktsegment", "c_nationkey"]])
    return spark.createDataFrame([(name, float(score), i) for i, (_, name, score) in enumerate(ranks, 1)], "index_name string, score double, rank_pos bigint")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_nationkey + 1 ELSE c_nationkey END AS c_nationkey FROM customer")
def doc_update_inc(spark, d):
    return documents.update(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), {"c_mktsegment": "BUILDING"}, {"$inc": {"c_nationkey": 1}}, "c_custkey").select("c_custkey", "c_nationkey")


@query("SELECT c_custkey, CASE WHEN c_nationkey = 5 THEN 'VIP' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def doc_update_set(spark, d):
    return documents.update(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), {"c_nationkey": 5}, {"$set": {"c_mktsegment": "VIP"}}, "c_custkey").select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, CASE WHEN c_nationkey = 5 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer")
def doc_update_unset(spark, d):
    return documents.update(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), {"c_nationkey": 5}, {"$unset": {"c_mktsegment": 1}}, "c_custkey").select("c_custkey", "c_mktsegment")


@query("SELECT CASE WHEN s_nationkey = 3 THEN s_suppkey + 1000000 ELSE s_suppkey END AS id, s_name FROM supplier")
def doc_upsert_key_move(spark, d):
    docs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), "s_name", "s_nationkey")
    return documents.upsert(docs, {"s_nationkey": 3}, {"$inc": {"id": 1000000}}, "id").select("id", "s_name")


@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'gone' ELSE c_name END AS c_name, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer")
def doc_replace(spark, d):
    return documents.replace(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), {"c_nationkey": 3}, {"c_name": "gone"}, "c_custkey").drop("c_nationkey")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT (c_mktsegment = 'BUILDING' AND c_nationkey = 5)")
def doc_delete(spark, d):
    return documents.delete(table(spark, d, "customer"), _WANTED).select("c_custkey", "c_name")


@query("SELECT c_custkey FROM (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer) t WHERE NOT (c_nationkey = 5 AND rn <= 10)")
def doc_delete_limit(spark, d):
    return documents.delete(table(spark, d, "customer").select("c_custkey", "c_nationkey"), {"c_nationkey": 5}, "c_custkey", 10).select("c_custkey")


# ---- text

_TOKENS = r"""tok AS (SELECT doc_id, lower(regexp_replace(w, '([-"'':+_=/|]{3,})', '', 'g')) AS word FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[-*()"''\[\]:\s?.,]+')) AS w FROM documents))"""


@query(f"WITH {_TOKENS} SELECT word, doc_id, count(*) AS freq FROM tok WHERE word <> '' GROUP BY word, doc_id")
def text_postings(spark, d):
    return textindex.postings(table(spark, d, "documents"))


@query(f"WITH {_TOKENS} SELECT doc_id, count(*) AS numwords FROM tok WHERE word <> '' GROUP BY doc_id")
def text_word_count(spark, d):
    return textindex.word_counts(table(spark, d, "documents"))


def _index(spark, d):
    return textindex.stored_index(table(spark, d, "documents"))


@query(f"WITH {_TOKENS} SELECT DISTINCT doc_id FROM tok WHERE word = 'the'")
def text_search_word(spark, d):
    return textindex.search_postings(_index(spark, d), ["the"])


@query(f"WITH {_TOKENS} SELECT doc_id FROM tok WHERE word IN ('the', 'of') GROUP BY doc_id HAVING count(DISTINCT word) = 2")
def text_search_and2(spark, d):
    return textindex.search_postings(_index(spark, d), ["the", "of"])


@query(f"WITH {_TOKENS} SELECT doc_id FROM tok WHERE word IN ('the', 'of', 'and') GROUP BY doc_id HAVING count(DISTINCT word) = 3")
def text_search_and3(spark, d):
    return textindex.search_postings(_index(spark, d), ["the", "of", "and"])


_PLACED = r"""pl AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[-*()"''\[\]:\s?.,]+'), lambda x: lower(regexp_replace(x, '([-"'':+_=/|]{3,})', '', 'g'))), lambda x: x <> '') AS ws FROM documents) t)"""


@query(f"WITH {_PLACED} SELECT word, doc_id, CAST(pos - 1 AS BIGINT) AS at FROM pl")
def text_positions(spark, d):
    return textindex.positions(table(spark, d, "documents")).withColumn("at", F.col("at").cast("bigint"))


@query(f"WITH {_TOKENS} SELECT doc_id FROM tok WHERE word IN ('the', 'of') AND doc_id > 100 GROUP BY doc_id HAVING count(DISTINCT word) = 2")
def text_search_after(spark, d):
    return textindex.search_postings(_index(spark, d), ["the", "of"], after=100)


@query(f"WITH {_PLACED} SELECT DISTINCT a.doc_id FROM pl a JOIN pl b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.word = 'of' AND b.word = 'the'")
def text_search_phrase(spark, d):
    return textindex.search_near(_index(spark, d), ["of", "the"])


@query(f"WITH {_PLACED} SELECT DISTINCT a.doc_id FROM pl a JOIN pl b ON a.doc_id = b.doc_id AND abs(b.pos - a.pos) < 5 WHERE a.word = 'thing' AND b.word = 'the'")
def text_search_near(spark, d):
    return textindex.search_near(_index(spark, d), ["thing", "the"], within=5)


@query(f"WITH {_TOKENS} SELECT doc_id FROM tok GROUP BY doc_id HAVING count(CASE WHEN word IN ('des', 'der') THEN 1 END) > 0 AND count(CASE WHEN word = 'die' THEN 1 END) = 0")
def text_search_any_not(spark, d):
    return textindex.search_any(_index(spark, d), ["des", "der"], without=["die"])


@query(f"WITH {_TOKENS}, f AS (SELECT word, doc_id, count(*) AS freq FROM tok WHERE word IN ('the', 'des', 'der') GROUP BY word, doc_id), n AS (SELECT word, count(*) AS df FROM f GROUP BY word) SELECT doc_id, round(sum(freq * ln((SELECT count(*) FROM documents)::DOUBLE / df)), 6) AS score FROM f JOIN n USING (word) GROUP BY doc_id")
def text_tf_idf(spark, d):
    docs = table(spark, d, "documents")
    return textindex.tf_idf(_index(spark, d), ["the", "des", "der"], docs.count()).withColumn("score", F.round("score", 6))


# ---- replication logs


def _log(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("server"), "event_id", "user_id", "ts")


@query("SELECT event_type AS server_guid, min(event_id) AS oldest_entry_pointer, max(event_id) AS log_commit_head FROM events GROUP BY event_type")
def log_status(spark, d):
    return replog.status(_log(spark, d), "server", "event_id")


@query("SELECT event_type AS server_guid, event_id AS logstamp FROM events WHERE event_type = 'click' AND event_id > 50")
def log_tail(spark, d):
    return replog.tail(_log(spark, d), "server", "event_id", "click", 50)


@query("SELECT event_type AS server_guid, count(*) AS remaining FROM events WHERE event_id > 50 GROUP BY event_type")
def log_remaining(spark, d):
    return replog.remaining(_log(spark, d), "server", "event_id", 50)


_RESUME = "ours AS (SELECT event_type AS g, max(event_id) AS head FROM events WHERE event_type <> 'signup' AND ts <= TIMESTAMP '2024-01-10 00:00:00' GROUP BY event_type), theirs AS (SELECT event_type AS g, min(event_id) AS oldest, max(event_id) AS head FROM events WHERE ts > TIMESTAMP '2024-01-05 00:00:00' GROUP BY event_type), act AS (SELECT t.g, CASE WHEN o.g IS NULL AND t.oldest <> 0 THEN 'rebuild' WHEN o.head < t.oldest THEN 'rebuild' WHEN o.head > t.head THEN 'resolve' ELSE 'replay' END AS action FROM theirs t LEFT JOIN ours o ON o.g = t.g)"


def _actions(spark, d):
    log = _log(spark, d)
    ours = replog.status(log.filter((F.col("server") != "signup") & (F.col("ts") <= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))), "server", "event_id")
    return replog.resume(ours, replog.status(log.filter(F.col("ts") > F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")), "server", "event_id"))


@query(f"WITH {_RESUME} SELECT g, action FROM act")
def log_resume_decision(spark, d):
    return _actions(spark, d)


@query(f"WITH {_RESUME} SELECT CASE WHEN count(*) FILTER (action = 'rebuild') > 0 THEN 'rebuild' WHEN count(*) FILTER (action = 'resolve') > 0 THEN 'resolve' ELSE 'replay' END AS decision FROM act")
def log_resume_global(spark, d):
    return replog.decision(_actions(spark, d))


@query("SELECT user_id, max(event_id) AS last_logstamp, count(*) AS applied FROM events WHERE event_type IN ('click','view') GROUP BY user_id")
def log_apply(spark, d):
    return replog.applied(_log(spark, d), "user_id", "event_id", ["click", "view"])


@query("SELECT event_type AS server, max(event_id) AS event_id FROM events GROUP BY event_type")
def log_truncate(spark, d):
    return replog.truncated(_log(spark, d).select("server", "event_id"), "server", "event_id")


@query("WITH seen AS (SELECT event_type AS g, max(event_id) AS head FROM events WHERE ts <= TIMESTAMP '2024-01-30 00:00:00' AND event_type <> 'signup' GROUP BY event_type), b AS (SELECT event_type AS server_guid, count(CASE WHEN event_id > coalesce(head, 0) THEN 1 END) AS behind FROM events LEFT JOIN seen ON g = event_type GROUP BY event_type) SELECT server_guid, behind, CASE WHEN behind < 5 THEN 'caught_up' WHEN behind > 30 THEN 'lost' ELSE 'following' END AS state FROM b")
def log_lag(spark, d):
    log = _log(spark, d)
    seen = log.filter((F.col("ts") <= F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")) & (F.col("server") != "signup"))
    return replog.lag(log, "server", "event_id", replog.status(seen, "server", "event_id").select("server_guid", F.col("log_commit_head").alias("at")))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_id <= 900) t WHERE rn = 1 AND event_type <> 'error'")
def log_rebuild(spark, d):
    """The data of a replica made anew from another server's updates up to a stamp."""
    source = updates(spark, d, "event_type").select("user_id", "event_id", "update_type", "event_type")
    data, _ = replog.rebuilt(source, _log(spark, d), ["user_id"], "event_id", 900)
    return data.select("user_id", "event_id", "event_type")


@query("WITH h AS (SELECT event_type AS g, max(event_id) AS head FROM events GROUP BY event_type) SELECT 'click' AS server, s_suppkey AS user_id, (SELECT head FROM h WHERE g = 'click') + row_number() OVER (ORDER BY s_suppkey) AS event_id FROM supplier")
def log_append(spark, d):
    log = _log(spark, d).select("server", "event_id", "user_id")
    new = table(spark, d, "supplier").select(F.lit("click").alias("server"), F.col("s_suppkey").alias("event_id"), F.col("s_suppkey").alias("user_id"))
    head = log.filter("server = 'click'").agg(F.max("event_id")).first()[0]
    return replog.append_entries(log, new, "server", "event_id").filter((F.col("server") == "click") & (F.col("event_id") > head)).select("server", "user_id", "event_id")


# ---- key templates and codecs


@query("SELECT n_nationkey, '/=' || r_name || '/=' || n_name AS row_key FROM nation JOIN region ON n_regionkey = r_regionkey")
def pipe_partition_key(spark, d):
    region = table(spark, d, "region")
    rows = table(spark, d, "nation").join(sized(region, region.count(), 64), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("n_nationkey", pipes.Partition("r_name", pipes.Partition("n_name")).key().alias("row_key"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '/=debit/=' || c_name ELSE '/=credit/=' || c_mktsegment END AS row_key FROM customer")
def pipe_mux_key(spark, d):
    side = F.when(F.col("c_acctbal") < 0, "debit").otherwise("credit")
    pipe = pipes.Mux(side, {"debit": pipes.Partition("c_name"), "credit": pipes.Partition("c_mktsegment")})
    return table(spark, d, "customer").select("c_custkey", pipe.key().alias("row_key"))


@query("SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def pipe_row_range(spark, d):
    """A row qualifier of an exact region and any nation, as one range of the key."""
    region = table(spark, d, "region")
    rows = table(spark, d, "nation").join(sized(region, region.count(), 64), F.col("n_regionkey") == F.col("r_regionkey"))
    key = pipes.Partition("r_name", pipes.Partition("n_name")).key()
    return rows.filter(pipes.in_row_range(key, ["ASIA", None])).select("n_nationkey")


@query("SELECT c_custkey, c_mktsegment AS segment, c_nationkey::BIGINT AS nation, c_custkey AS id FROM customer")
def key_decode(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    key = keys.encode(keys.string_part(F.col("c_mktsegment")), keys.long_part(F.col("c_nationkey")), keys.long_part(F.col("c_custkey")))
    held = rows.select("c_custkey", key.alias("key"))
    segment, nation, ident = keys.decode_parts(F.col("key"), keys.STRING, keys.LONG, keys.LONG)
    return held.select("c_custkey", segment.alias("segment"), nation.alias("nation"), ident.alias("id"))


@query("SELECT p_partkey FROM part WHERE '=' || p_brand = '=Brand#12'")
def qualifier_exact(spark, d):
    return table(spark, d, "part").filter(pipes.exact(F.col("p_brand"), "Brand#12")).select("p_partkey")


@query("SELECT p_brand, count(*) AS n FROM part WHERE '=' || p_brand BETWEEN '<' AND '>' GROUP BY p_brand")
def qualifier_any(spark, d):
    return table(spark, d, "part").filter(pipes.anything(F.col("p_brand"))).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR(20)), 13, '0') AS lsd FROM orders")
def lsd_encode(spark, d):
    return table(spark, d, "orders").select("o_orderkey", codec.lsd(F.col("o_orderkey"), 13).alias("lsd"))


@query(f"SELECT event_id, list_reduce(list_prepend(0, list_transform(range(1, length(props) + 1), lambda i: ascii(props[i]))), lambda c, b: xor(c >> 8, list_extract({codec.crc16_table()}, (xor(c, b) & 255) + 1))) AS crc FROM events")
def crc16(spark, d):
    return table(spark, d, "events").select("event_id", codec.crc16(F.col("props").cast("binary")).alias("crc"))


# ---- streams


@query("SELECT user_id, k, event_id, value FROM (SELECT user_id, event_id % 10 AS k, event_id, value, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 10 ORDER BY event_id DESC) = 1) t WHERE event_type <> 'error'")
def stream_newest_wins(spark, d):
    """The events as a stream, its batches written as generations, then read merged."""
    events = ingest.stream_table(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", lsm.TOMBSTONE).otherwise(lsm.FULL)
    log = events.select("user_id", (F.col("event_id") % 10).alias("k"), "event_id", "value", kind.alias("update_type"))
    path = fresh_path(spark, "stream")
    started = ingest.ingest(log, f"{path}/log", _KEY, ["event_id"], f"{path}/state")
    started.awaitTermination()
    return ingest.merged(spark, f"{path}/log", _KEY, ["event_id"]).select("user_id", "k", "event_id", "value")
