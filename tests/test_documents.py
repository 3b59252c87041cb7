"""Documents, text search, pipes, replication logs, sources and streams."""

import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sortmill.operators import documents, pipes, replog, textindex
from sortmill.plans.catalogue import QUERIES
from sortmill.sources import mail
from sortmill.streaming import ingest


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([("user1", "David", 60), ("user2", "Tom", 32), ("user3", "Tom", 32), ("user4", None, None)], "_id string, name string, age int")


def test_find_and_index(users):
    assert {r._id for r in documents.find(users, {"name": "Tom", "age": 32}).collect()} == {"user2", "user3"}
    assert documents.find(users, {}).count() == 4 and documents.find(users, {"name": "tom"}).count() == 0
    index = documents.index_entries(users, ["name"], "_id")
    assert {r._id for r in documents.find_via_index(users, index, ["name"], "_id", {"name": "Tom"}).collect()} == {"user2", "user3"}
    assert documents.rank_indexes({"name": 1, "age": 2}, [["_id"], ["name"], ["age"], ["name", "age"]])[0] == (3, "name,age", 2)
    assert documents.rank_indexes({"x": 1}, [["_id"], ["name"]])[0] == (0, "_id", 0.1)
    assert [i for i, _, s in documents.rank_indexes({"name": 1, "age": 2}, [["_id"], ["name"], ["age"]])] == [2, 1, 0]


def test_updates(users):
    got = {r._id: r.age for r in documents.update(users, {"name": "Tom"}, {"$inc": {"age": 1}}, "_id").collect()}
    assert got == {"user1": 60, "user2": 33, "user3": 33, "user4": None}
    assert {r._id: r.age for r in documents.update(users, {"_id": "user4"}, {"$inc": {"age": 5}}, "_id").collect()}["user4"] == 5
    once = documents.update(users, {"name": "Tom"}, {"$set": {"age": 0}}, "_id", limit=1)
    assert sorted((r._id, r.age) for r in once.collect() if r.age == 0) == [("user2", 0)]
    gone = documents.update(users, {"name": "Tom"}, {"$unset": {"age": 1}}, "_id")
    assert {r._id for r in gone.filter("age IS NULL").collect()} == {"user2", "user3", "user4"}
    assert documents.delete(users, {"name": "Tom"}).count() == 2
    assert {r._id for r in documents.delete(users, {"name": "Tom"}, "_id", 1).collect()} == {"user1", "user3", "user4"}
    assert {r._id for r in documents.delete_per_group(users, {"name": "Tom"}, "_id", 1, ["name"]).collect()} == {"user1", "user3", "user4"}
    replaced = {r._id: (r.name, r.age) for r in documents.replace(users, {"name": "David"}, {"age": 1}, "_id").collect()}
    assert replaced["user1"] == (None, 1) and replaced["user2"] == ("Tom", 32)
    moved = documents.update(users, {"_id": "user1"}, {"_id": "user9"}, "_id")
    assert {r._id for r in moved.collect()} == {"user9", "user2", "user3", "user4"}


def test_upsert(users):
    new = documents.upsert(users, {"_id": "user7"}, {"$inc": {"age": 2}}, "_id")
    assert {r._id: r.age for r in new.collect()}["user7"] == 2 and new.count() == 5
    assert documents.upsert(users, {"_id": "user1"}, {"$inc": {"age": 2}}, "_id").count() == 4


def test_nested_updates(spark):
    df = spark.createDataFrame([(1, 4, (4, "x"), ["p", "q"])], "_id int, count int, a struct<count:int,s:string>, tags array<string>")
    one = lambda spec: documents.update(df, {}, spec, "_id").first()
    assert one({"$inc": {"count": 5}})["count"] == 9 and one({"$inc": {"a.count": 5}}).a["count"] == 9
    assert one({"$inc": {"a.s": 5}}).a["s"] == "5"  # no number: replaced by the increment
    assert one({"a": {"s": "y"}}).a.asDict() == {"count": 4, "s": "y"}
    assert one({"$unset": {"a.s": 1}}).a.asDict() == {"count": 4, "s": None}
    assert "b" not in one({"$unset": {"b.c": 1}}).asDict()  # no parents are made
    assert one({"$set": {"a.count": 1}})["a.count"] == 1  # the name is literal
    assert one({"$push": {"tags": "r"}}).tags == ["p", "q", "r"] and one({"$addToSet": {"tags": "p"}}).tags == ["p", "q"]
    assert one({"$pop": {"tags": 1}}).tags == ["p"] and one({"$pop": {"tags": -1}}).tags == ["q"]
    assert one({"$pull": {"tags": "p"}}).tags == ["q"] and one({"$pullAll": {"tags": ["p", "q"]}}).tags == []
    assert one({"$pushAll": {"tags": ["r", "s"]}}).tags == ["p", "q", "r", "s"]
    assert one({"$rename": {"count": "n"}}).n == 4
    for bad in ({"$what": {"a": 1}}, {"$inc": {"count": "x"}}):
        with pytest.raises(ValueError):
            one(bad)


def test_text_index(spark):
    df = spark.createDataFrame([(1, "The cat -- the CAT's hat"), (2, "a cat, a hat (and) the--- dog"), (3, ""), (4, None), (5, "..., ???")], "doc_id int, text string")
    got = {(r.word, r.doc_id): r.freq for r in textindex.postings(df).collect()}
    assert got[("the", 1)] == 2 and got[("cat", 1)] == 2 and got[("s", 1)] == 1 and ("dog", 2) in got
    assert {r.doc_id: r.numwords for r in textindex.word_counts(df).collect()} == {1: 6, 2: 7}
    find = lambda *t: sorted(r.doc_id for r in textindex.search(df, list(t)).collect())
    assert find("cat", "hat", "the") == [1, 2] and find("The") == [] and find() == [] and find("cat", "cat", "dog") == [2]
    assert [r.doc_id for r in textindex.search(df, ["cat"], after=1).collect()] == [2]
    index = textindex.postings(df)
    assert sorted(r.doc_id for r in textindex.search_postings(index, ["cat", "hat", "the"]).collect()) == [1, 2]
    assert textindex.query_terms("The  CAT") == ["The", "CAT"] and textindex.query_terms("The  CAT", True) == ["the", "cat"]
    assert sorted((r.word, r.at) for r in textindex.positions(df.filter("doc_id = 1")).collect())[0] == ("cat", 1)
    listed = spark.createDataFrame([(1, ["x", "y", "x"])], "doc_id int, words array<string>")
    assert {(r.word, r.freq) for r in textindex.postings_of_words(listed, "doc_id", "words").collect()} == {("x", 2), ("y", 1)}


def test_pipes(spark):
    df = spark.createDataFrame([("jeff", "foo", "path_a", "sub"), ("ann", "bar", "path_b", "sub")], "username string, tablename string, selector string, part string")
    key = pipes.Partition("username", pipes.Partition("tablename")).key()
    assert [r.k for r in df.select(key.alias("k")).collect()] == ["/=jeff/=foo", "/=ann/=bar"]
    assert df.select(pipes.parts_of(key).alias("k")).first().k == ["jeff", "foo"]
    mux = pipes.Mux("selector", {"path_a": pipes.Partition("part"), "path_b": pipes.End()})
    assert [r.k for r in df.select(mux.key().alias("k")).collect()] == ["/=path_a/=sub", "/=path_b"]
    for bad in (pipes.Mux("selector", {"path_a": pipes.End()}), pipes.Partition("missing")):
        with pytest.raises(Exception, match="no route|missing context"):
            df.withColumn("missing", F.lit(None).cast("string")).select(bad.key()).collect()
    assert df.withColumn("m", F.lit(None).cast("string")).select(pipes.Partition("m", default="d").key().alias("k")).first().k == "/=d"


def test_qualifiers(spark):
    df = spark.createDataFrame([("M",), ("A",), ("ZZ",), (None,)], "v string")
    assert [r.v for r in pipes.qualify(df, v="M").collect()] == ["M"] and pipes.qualify(df, v=None).count() == 3
    with pytest.raises(ValueError):
        pipes.exact(F.col("v"), None)
    assert df.filter(pipes.starts(F.col("v"), "Z")).count() == df.filter(pipes.containing(F.col("v"), "A")).count() == 1
    assert df.filter(pipes.excluding(F.col("v"), "A")).count() == 2


def test_replication(spark):
    log = spark.createDataFrame([("a", 1, "k1"), ("a", 2, "k1"), ("a", 3, "k2"), ("b", 7, "k1")], "server string, at int, key string")
    assert {r.server_guid: (r.oldest_entry_pointer, r.log_commit_head) for r in replog.status(log, "server", "at").collect()} == {"a": (1, 3), "b": (7, 7)}
    assert [r["at"] for r in replog.fetch(log, "server", "at", "a", 1, limit=1).collect()] == [2]
    assert replog.fetch(log, "server", "at", "a", 0).count() == 3
    with pytest.raises(LookupError):
        replog.fetch(log, "server", "at", "b", 5)
    status = "server_guid string, oldest_entry_pointer int, log_commit_head int"
    ours = spark.createDataFrame([("old", 1, 3), ("ahead", 1, 9), ("same", 1, 5)], status)
    theirs = spark.createDataFrame([("old", 4, 9), ("ahead", 1, 5), ("same", 1, 5), ("new", 3, 4), ("fresh", 0, 2)], status)
    actions = replog.resume(ours, theirs)
    assert {r.g: r.action for r in actions.collect()} == {"old": "rebuild", "ahead": "resolve", "same": "replay", "new": "rebuild", "fresh": "replay"}
    assert replog.decision(actions).first().decision == "rebuild"  # though another log must be resolved
    data = spark.createDataFrame([("k1", 1, "FULL"), ("k2", 1, "FULL")], "key string, at int, update_type string")
    more = spark.createDataFrame([("k1", 2, "DELETION_TOMBSTONE"), ("k3", 3, "FULL")], data.schema)
    assert {r.key for r in replog.replay(data, more, ["key"], "at").collect()} == {"k2", "k3"}
    seen = spark.createDataFrame([("a", 2)], "server_guid string, at int").withColumnRenamed("at", "at_")
    lag = replog.lag(log.withColumnRenamed("at", "stamp"), "server", "stamp", seen.withColumnRenamed("at_", "at"))
    assert {r.server_guid: (r.behind, r.state) for r in lag.collect()} == {"a": (1, "caught_up"), "b": (1, "caught_up")}


def test_mbox(spark, tmp_path):
    (tmp_path / "box").write_text("From a@x Mon\nSubject: one\n\nhello\nFrom here on\n\nFrom b@x Tue\nSubject: two\n\nworld\n")
    got = mail.read_mbox(spark, str(tmp_path / "box")).collect()
    assert [r.body.strip() for r in got if "Subject" in r.message] == ["hello", "world"]  # the last message too
    assert mail.made_up(spark, 3, 50).count() == 3 and len(mail.made_up(spark, 1, 50).first().words) == 50


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = "key string, seq int, update_type string, value string"
    spark.createDataFrame([("a", 1, "FULL", "a1"), ("b", 2, "FULL", "b2"), ("a", 3, "FULL", "a3")], schema).coalesce(1).write.parquet(f"{folder}/t.parquet")

    def run():
        q = ingest.ingest(ingest.stream_table(spark, folder, "t"), str(tmp_path / "log"), ["key"], ["seq"], str(tmp_path / "state"))
        q.awaitTermination()
        return {r.key: r.value for r in ingest.merged(spark, str(tmp_path / "log"), ["key"], ["seq"]).collect()}

    assert run() == {"a": "a3", "b": "b2"}
    spark.createDataFrame([("b", 4, "DELETION_TOMBSTONE", None), ("c", 5, "FULL", "c5")], schema).coalesce(1).write.mode("append").parquet(f"{folder}/t.parquet")
    assert run() == {"a": "a3", "c": "c5"}


def test_find_takes_the_best_index_and_inserts_replace(spark, users, tmp_path):
    made = {}
    for fields in (("name",), ("age", "name")):
        documents.ensure_index(users, list(fields), "_id", str(tmp_path / "+".join(fields)))
        made[fields] = spark.read.parquet(str(tmp_path / "+".join(fields)))
    for query in ({"name": "Tom"}, {"name": "Tom", "age": 32}, {"age": 60}, {"_id": "user1"}, {"_id": "user1", "name": "David"}, {}):
        found = documents.find_best(users, query, "_id", made)
        assert {r._id for r in found.collect()} == {r._id for r in documents.find(users, query).collect()}
        read = " ".join(found.inputFiles())
        assert ("age+name" in read) == ("age" in query) and ("/name/" in read) == ("name" in query and "age" not in query and "_id" not in query)
    new = spark.createDataFrame([("user1", "Dave", "x"), ("user8", "New", "y")], "_id string, name string, more string")
    assert {r._id: (r.name, r.age, r.more) for r in documents.insert(users, new, "_id").collect()} == {"user1": ("Dave", None, "x"), "user2": ("Tom", 32, None), "user3": ("Tom", 32, None), "user4": (None, None, None), "user8": ("New", None, "y")}


def test_columns_that_clash_with_helpers_stay(users):
    df = users.withColumns({c: F.lit(7) for c in ("hit", "chosen", "gone", "nth", "own_pk", "__hit", "__nth")})
    got = documents.update(df, {"name": "Tom"}, {"$inc": {"age": 1}}, "_id", limit=1)
    assert got.columns == df.columns and {r["__hit"] for r in got.collect()} == {7}
    assert documents.delete(df, {"name": "Tom"}, "_id", 1).columns == df.columns
    assert documents.delete_per_group(df, {"name": "Tom"}, "_id", 1, ["name"]).columns == df.columns


def test_stored_index_is_pruned_and_searched(spark, tmp_path):
    texts = [(1, "the cat sat on the mat"), (2, "on the mat the cat"), (3, "the dog"), (4, None), (5, "mat cat"), (6, "cat - the, cat")]
    spark.createDataFrame(texts, "doc_id int, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    index = textindex.stored_index(docs)
    assert textindex.stored_index(docs).inputFiles() == index.inputFiles()  # written once
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    for terms in (["the"], ["the", "cat"], ["cat", "mat", "cat"], ["absent"], []):
        assert ids(textindex.search_postings(index, terms)) == ids(textindex.search(docs, terms))
    assert ids(textindex.search_postings(index, ["cat"], after=1)) == [2, 5, 6]
    assert ids(textindex.search_near(index, ["the", "cat"])) == [1, 2, 6] and ids(textindex.search_near(index, ["the", "mat"])) == [1, 2]
    assert ids(textindex.search_near(index, ["on", "the", "mat"])) == [1, 2] and ids(textindex.search_near(index, ["mat", "on"])) == []
    assert ids(textindex.search_near(index, ["mat", "cat"], within=2)) == [5] and ids(textindex.search_near(index, ["mat", "cat"], within=3)) == [2, 5]
    assert ids(textindex.search_any(index, ["dog", "mat"])) == [1, 2, 3, 5] and ids(textindex.search_any(index, ["cat"], without=["on"])) == [5, 6]
    score = {r.doc_id: r.score for r in textindex.tf_idf(index, ["dog", "cat"], 6).collect()}
    assert score[3] > score[6] > score[1] == score[2]
    plan = textindex.search_postings(index, ["the"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(word, [the])]" in plan or "EqualTo(word,the)" in plan


def test_index_is_built_without_a_shuffle(spark, tmp_path):
    texts = [(i, f"the cat {i} saw the cat {i % 7} of the house") for i in range(200)]
    spark.createDataFrame(texts, "doc_id int, text string").repartition(4).write.parquet(str(tmp_path / "docs"))
    docs, tracker = spark.read.parquet(str(tmp_path / "docs")), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("index-build", "")
    try:
        textindex.write_index(docs, str(tmp_path / "index"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("index-build")]
    assert [len(j.stageIds) for j in jobs] == [1]
    index = spark.read.parquet(str(tmp_path / "index"))
    placed = {(r.word, r.doc_id): (r.freq, r["at"]) for r in index.collect()}
    assert placed[("cat", 9)] == (2, [1, 5]) and placed[("the", 9)] == (3, [0, 4, 8]) and len(placed) == index.count()
    want = {(r.word, r.doc_id): r.freq for r in textindex.postings(docs).collect()}
    assert {k: freq for k, (freq, _) in placed.items()} == want


def test_search_after_shuffles_its_hits_only(spark, tmp_path):
    texts = [(i, ["the top of it", "the of", "of", "the"][i % 4]) for i in range(90, 130)]
    spark.createDataFrame(texts, "doc_id int, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("search-after", "")
    try:
        found = QUERIES["text_search_after"](spark, str(tmp_path))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("search-after")]
    assert jobs and all(len(j.stageIds) == 1 for j in jobs)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(r.doc_id for r in found.collect()) == [i for i in range(101, 130) if i % 4 < 2]


def test_search_after_moves_no_more_than_its_index(spark, tmp_path):
    """Bytes shuffled, spilled and written, of two sizes: nearly all are the index, and they grow no faster than the texts."""
    store, tracker = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext.statusTracker()
    moved = {}
    for n in (2000, 8000):
        docs = spark.range(n).selectExpr("id AS doc_id", "concat_ws(' ', 'the top of it', transform(sequence(0, 99), k -> concat('w', pmod(hash(id, k), 5000)))) AS text")
        docs.repartition(2).write.parquet(str(tmp_path / f"{n}/documents.parquet"))
        spark.sparkContext.setJobGroup(f"moved-{n}", "")
        try:
            QUERIES["text_search_after"](spark, str(tmp_path / f"{n}")).write.parquet(str(tmp_path / f"{n}/found"))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = [store.lastStageAttempt(k) for k in {k for j in tracker.getJobIdsForGroup(f"moved-{n}") for k in tracker.getJobInfo(j).stageIds}]
        stages = [x for x in stages if x.status().toString() == "COMPLETE"]
        between, written = sum(x.shuffleWriteBytes() + x.diskBytesSpilled() for x in stages), sum(x.outputBytes() for x in stages)
        assert written > 0 and between < written / 10
        moved[n] = between + written
        assert spark.read.parquet(str(tmp_path / f"{n}/found")).count() == n - 101
    assert moved[8000] < 4.4 * moved[2000]


def test_runs_of_any_length_hold_every_occurrence(monkeypatch):
    texts = [(1, "b a b"), (2, "a"), (2, "c b c c"), (None, "a é b"), (3, "b")]
    rows = [(w, d, at) for d, text in texts for at, w in enumerate(text.split())]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("word", "doc_id", "at"), r, strict=True)) for r in rows[k : k + 2]], schema=pa.schema({"word": pa.string(), "doc_id": pa.int32(), "at": pa.int32()})) for k in range(0, len(rows), 2)]
    for length in (1, 3, 5, 100):
        monkeypatch.setattr(textindex, "RUN", length)
        got = [list(map(tuple, (r.values() for r in b.to_pylist()))) for b in textindex.sorted_runs(iter([batches[0].slice(0, 0), *batches]))]
        assert all([w for w, *_ in run] == sorted(w for w, *_ in run) and all(n == len(at) for _, _, n, at in run) for run in got)
        assert sorted(((w, d, a) for run in got for w, d, _, at in run for a in at), key=str) == sorted(rows, key=str)
    assert got == [[("a", 1, 1, [1]), ("a", 2, 1, [0]), ("a", None, 1, [0]), ("b", 1, 2, [0, 2]), ("b", 2, 1, [1]), ("b", None, 1, [2]), ("b", 3, 1, [0]), ("c", 2, 3, [0, 2, 3]), ("é", None, 1, [1])]]
    assert list(textindex.sorted_runs(iter([]))) == []


def test_stored_index_unites_rows_of_one_document(spark, tmp_path):
    parts = [[(1, "the cat"), (None, "a dog"), (2, "the mat")], [(1, "of the mat"), (None, "the cat"), (3, ""), (4, None)], [(1, "the cat"), (2, "dog dog")]]
    for part in parts:
        spark.createDataFrame(part, "doc_id int, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    index = textindex.stored_index(docs)
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=str)
    assert ids(textindex.search_postings(index, ["cat", "mat"])) == [1] and ids(textindex.search_postings(index, ["the"])) == [1, 2, None]
    assert ids(textindex.search_postings(index, ["dog", "cat"])) == [None] and ids(textindex.search_postings(index, ["dog", "mat"], after=1)) == [2]
    assert ids(textindex.search_near(index, ["the", "mat"])) == [1, 2] and ids(textindex.search_near(index, ["cat", "mat"], within=2)) == [1]
    assert ids(textindex.search_any(index, ["cat"], without=["mat"])) == [None]
    score = {r.doc_id: round(r.score, 9) for r in textindex.tf_idf(index, ["cat", "dog"], 8).collect()}
    assert score == {1: round(2 * math.log(4), 9), 2: round(2 * math.log(4), 9), None: round(2 * math.log(4), 9)}


def test_logs_append_rebuild_and_instances(spark):
    log = spark.createDataFrame([("a", 1, "k"), ("a", 2, "l"), ("b", 7, "m")], "server string, logstamp bigint, key string")
    new = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("c", 5, "z")], "server string, logstamp bigint, key string")
    got = replog.append_entries(log, new, "server", "logstamp")
    assert {(r.server, r.logstamp, r.key) for r in got.collect()} == {("a", 1, "k"), ("a", 2, "l"), ("b", 7, "m"), ("a", 3, "x"), ("a", 4, "y"), ("c", 1, "z")}
    ours, theirs = replog.status(log, "server", "logstamp"), replog.status(got, "server", "logstamp")
    with pytest.raises(ValueError, match="instance"):
        replog.resume(ours, theirs, ("one", "two"))
    assert {r.g: r.action for r in replog.resume(ours, theirs, ("one", "one")).collect()} == {"a": "replay", "b": "replay", "c": "rebuild"}
    source = spark.createDataFrame([("k", 1, "FULL"), ("k", 3, "DELETION_TOMBSTONE"), ("l", 2, "FULL")], "key string, logstamp bigint, update_type string")
    for until, want in ((2, {"k", "l"}), (3, {"l"})):
        data, heads = replog.rebuilt(source, log, ["key"], "logstamp", until)
        assert {r.key for r in data.collect()} == want and heads.count() == 2


def test_row_qualifiers(spark):
    df = spark.createDataFrame([("ASIA", "x"), ("ASIA", "y"), ("ASIAN", "x"), ("EUROPE", "x")], "r string, n string").withColumn("key", pipes.Partition("r", pipes.Partition("n")).key())
    at = lambda *parts: sorted((r.r, r.n) for r in df.filter(pipes.in_row_range(F.col("key"), list(parts))).collect())
    assert at("ASIA", None) == [("ASIA", "x"), ("ASIA", "y")] and at("ASIA", "y") == [("ASIA", "y")] and len(at(None, None)) == 4
    assert pipes.looked_up(df, "n", spark.createDataFrame([("y",), ("y",)], "v string"), "v").count() == 1
    assert df.filter(pipes.ranging(F.col("r"), "ASIA", "ASIAN")).count() == 3 and df.filter(pipes.ranging(F.col("r"), None, "ASIA")).count() == 2
    assert {tuple(r.c) for r in df.select(pipes.context_of(F.col("key"), ["a", "b", "c"]).alias("c")).collect()} == {("ASIA", "x", None), ("ASIA", "y", None), ("ASIAN", "x", None), ("EUROPE", "x", None)}
