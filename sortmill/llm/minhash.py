"""Near-duplicate documents from bottom-k sketches of one hash function.

Each document is the set of its word trigrams, as 64-bit hashes. Its sketch is the SKETCH smallest of them.

1. Documents of equal sets (128 bits of set hash and the size agree) fold into the smallest doc_id.
2. Inverted lists: (value, document) for the retained values, rarest first. Two sketches that share at least RETAINED of
   their values must share one among each one's rarest 1 - RETAINED of them plus one, so only that part is listed. A passage that
   very many documents share is frequent, and drops out of the lists of all that have enough else.
3. Each list pairs its members with a leader, drawn by hash in one of ORDERS orders, which the list's value chooses.
   A list of m members makes m-1 pairs, so what resembles its leaders is grouped at a cost in proportion.
4. The union sketch of each pair estimates its Jaccard similarity; pairs far below the threshold go.
5. The exact Jaccard similarity of the two sets verifies the rest.
6. Then each list pairs all those of its members that are not in one group yet, whichever they are, and 4 and 5 follow: first for
   the pairs whose estimate reaches the threshold, then for the others that these leave in different groups. So the groups are
   those that all pairs of every list would give; only members that no group joins cost the square of their number.
7. Connected components of the verified pairs are the groups; the smallest doc_id stands for its group.

Defined cases: rows with null doc_id cannot be named, so they belong to no group and stay. Texts that are null or have
no word belong to no group. A text of one or two words is one shingle. Rows that repeat a doc_id are one document, that of the
smallest set hash among those with words; `deduplicate` keeps that row, of equal sets the one of smallest text, and of rows
without words the first in order of text. doc_id must be a whole number, or cast to one. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from sortmill.llm._text import blocks, byte_view, mix64, powers64, release, word_hashes, word_spans
from sortmill.llm._work import discard, fresh, slim_batches, small, written

#: Changing one word in ten leaves two texts a Jaccard similarity of 0.57 in trigrams; a few per cent leave 0.8.
SHINGLE, SKETCH, THRESHOLD = 3, 64, 0.55
#: Share of retained values that a pair must have in common to be found; some 3 standard deviations below what THRESHOLD gives.
RETAINED = 0.45
ORDERS = 4
#: Estimates this far below THRESHOLD (2.6 standard deviations at SKETCH values) go without verification.
SLACK = 0.15
#: A list of more groups than this is split, and each part paired with the whole list by a task of its own.
PART = 1000
BLOCK = 1 << 20


def shingle_sets(column: pa.Array, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes, as signed 64-bit integers."""
    raw, offsets = byte_view(column)
    mult = powers64(0xD6E8FEB86659FD93, width)
    for i, j in blocks(offsets, BLOCK):
        o = offsets[i : j + 1] - offsets[i]
        starts, ends, first = word_spans(raw[offsets[i] : offsets[j]], o)
        h = word_hashes(raw[offsets[i] : offsets[j]], starts, ends)
        n = max(len(h) - width + 1, 0)
        g = np.zeros(n, np.uint64)
        for q in range(width):
            g += h[q : q + n] * mult[q]
        g = mix64(g).view(np.int64)
        for d in range(j - i):
            a, b = int(first[d]), int(first[d + 1])
            if b - a >= width:
                yield np.unique(g[a : b - width + 1])
            elif b > a:
                yield mix64(np.array([(h[a:b] * mult[: b - a]).sum(dtype=np.uint64)])).view(np.int64)
            else:
                yield np.empty(0, np.int64)


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits for a set of shingles, as two signed integers."""
    u = s.view(np.uint64)
    if not len(u):
        return 0, 0
    return int(u.sum(dtype=np.uint64).view(np.int64)), int(mix64(u ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64))


@F.arrow_udf(T.StructType().add("h1", T.LongType()).add("h2", T.LongType()).add("n", T.IntegerType()))
def set_hash(text: pa.Array) -> pa.Array:
    made = [(*_set_hash(s), len(s)) for s in shingle_sets(text)]
    return pa.StructArray.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], ["h1", "h2", "n"])


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, h1, h2, sketch = [], [], [], []
        for s in shingle_sets(batch.column(1)):
            a, b = _set_hash(s)
            n.append(len(s))
            h1.append(a)
            h2.append(b)
            sketch.append(s[:SKETCH])
        lengths = np.array([0, *map(len, sketch)], np.int32).cumsum(dtype=np.int32)
        values = np.concatenate(sketch) if sketch else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.ListArray.from_arrays(pa.array(lengths), pa.array(values))],
            ["doc", "n", "h1", "h2", "sketch"],
        )
        release()


def sketches(docs: DataFrame) -> DataFrame:
    """(doc, n, h1, h2, sketch): one row for each row of `docs` with a doc_id and a word."""
    slim_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc"), F.col("text").cast("string").alias("text")).filter("doc IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(_sketch_batches, "doc bigint, n int, h1 bigint, h2 bigint, sketch array<bigint>").filter("n > 0")


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = shingle_sets(batch.column(2)), shingle_sets(batch.column(3))
        j = []
        for a, b in zip(left, right):
            both = len(np.intersect1d(a, b, assume_unique=True))
            j.append(both / max(len(a) + len(b) - both, 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(j, pa.float64())], ["a", "b", "jaccard"])
        release()


def inverted_lists(distinct: DataFrame) -> DataFrame:
    """(doc, value): the lists of the values that `distinct` (doc, sketch) retains, each document in those of its rarest."""
    entries = distinct.select("doc", F.size("sketch").alias("kept"), F.explode("sketch").alias("value"))
    shared = entries.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    mine = W.partitionBy("doc")
    # Values that no other document retains come first in the order; they are the kept - here values that the join dropped.
    prefix = (
        entries.join(shared, "value")
        .withColumn("rank", F.row_number().over(mine.orderBy("df", "value")))
        .withColumn("here", F.count("*").over(mine))
        .filter(F.col("rank") + F.col("kept") - F.col("here") <= F.col("kept") - F.ceil(F.col("kept") * RETAINED) + 1)
        .select("doc", "value")
    )
    return written(prefix, "minhash-lists")


def leader_pairs(lists: DataFrame) -> DataFrame:
    """(a, b) with a < b, each once: the members of each list with its leader."""
    drawn = F.struct(F.xxhash64("doc", F.pmod("value", F.lit(ORDERS))).alias("draw"), F.col("doc").alias("leader"))
    leaders = lists.groupBy("value").agg(F.min(drawn).alias("m"), F.count("*").alias("c")).filter("c > 1").select("value", "m.leader")
    met = lists.join(leaders, "value").filter("doc <> leader")
    return met.select(F.least("doc", "leader").alias("a"), F.greatest("doc", "leader").alias("b")).distinct()


def apart_pairs(lists: DataFrame, groups: DataFrame, distinct: DataFrame) -> DataFrame:
    """(a, b) with a < b, each once: all pairs of each list that `groups` (doc, rep) leaves apart and whose sizes can reach the threshold."""
    sizes = distinct.select("doc", "n").join(groups, "doc", "left").select("doc", "n", F.coalesce("rep", "doc").alias("rep"))
    split = lists.join(sizes, "doc").groupBy("value", "rep").agg(F.collect_list(F.struct("doc", "n")).alias("docs"))
    split = written(split, "minhash-split")
    parts = split.groupBy("value").agg(F.count("*").alias("c")).filter("c > 1").select("value", F.ceil(F.col("c") / PART).cast("int").alias("parts"))
    split = split.join(parts, "value")
    left = split.select("value", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"), F.col("rep").alias("r"), F.col("docs").alias("x"))
    right = split.select("value", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("rep").alias("q"), F.col("docs").alias("y"))
    met = left.join(right, ["value", "part"]).filter("r < q").select(F.explode("x").alias("x"), "y").select("x", F.explode("y").alias("y"))
    met = met.filter(F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * THRESHOLD)
    return met.select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b")).distinct()


def _estimated(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(a, b, likely): the pairs whose union sketch estimates a similarity within SLACK of the threshold; likely, if it reaches it."""
    side = lambda k: distinct.select(F.col("doc").alias(k), F.col("sketch").alias("s" + k), F.col("n").alias("n" + k))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
    shared = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    ratio = F.least("na", "nb") >= F.greatest("na", "nb") * THRESHOLD  # sets of such sizes only can reach the threshold
    near = both.filter(ratio).select("a", "b", shared.alias("shared"), F.size(union).alias("of"))
    return near.filter(F.col("shared") >= F.col("of") * (THRESHOLD - SLACK)).select("a", "b", (F.col("shared") >= F.col("of") * THRESHOLD).alias("likely"))


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Those of `pairs` that `groups` leaves apart."""
    of = lambda k: groups.select(F.col("doc").alias(k), F.col("rep").alias("r" + k))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select(*pairs.columns)


def near_groups(docs: DataFrame, distinct: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """(doc, rep) for each of `distinct` that is in a group, but the representatives. `again` is as for `verified_pairs`."""
    lists = inverted_lists(distinct)
    near = written(verified_pairs(docs, written(_estimated(leader_pairs(lists), distinct), "minhash-pairs"), again), "minhash-verified")
    groups = components(near)
    rest = written(_estimated(apart_pairs(lists, groups, distinct), distinct), "minhash-rest")
    for likely in (True, False):
        pairs = written(_apart(rest.filter(F.col("likely") == likely), groups), "minhash-apart")
        if pairs.isEmpty():
            continue
        more = written(verified_pairs(docs, pairs, again), "minhash-verified")
        # A group's star joins what its verified pairs join.
        stars = groups.select(F.col("doc").alias("a"), F.col("rep").alias("b"))
        groups = components(stars.unionByName(more.select("a", "b")))
    return groups


def verified_pairs(docs: DataFrame, pairs: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """(a, b, jaccard): those of `pairs` whose exact Jaccard similarity reaches the threshold.

    `again` is (doc, m): the ids that rows repeat, with the set hash of the row that counts.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc"), F.col("text").cast("string").alias("text")).filter("doc IS NOT NULL AND text IS NOT NULL")
    texts = texts.join(small(ids, ids.count(), 16), "doc", "left_semi")
    if again is not None:
        rows = again.count()
        more = texts.join(small(again, rows, 64), "doc").withColumn("s", set_hash("text")).filter("s = m")
        more = more.groupBy("doc").agg(F.min("text").alias("text"))  # of equal sets any text verifies alike
        texts = texts.join(small(again.select("doc"), rows, 16), "doc", "left_anti").unionByName(more)
    texts = written(texts, "minhash-texts")
    both = pairs.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(_verify_batches, "a bigint, b bigint, jaccard double").filter(F.col("jaccard") >= THRESHOLD)


def components(edges: DataFrame) -> DataFrame:
    """(doc, rep) for each node of `edges` (a, b) but the representatives, rep being the smallest node of its component.

    Alternating large-star and small-star rounds; each round's edges are written, so lineage stays short.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "components")
    before = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(down, "u")
        joined = star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        joined = written(joined, "components")
        discard(edges)  # only the last round's edges are read again
        edges = joined
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("doc"), F.col("v").alias("rep"))
        before = state


def duplicate_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id, rep_id): every document that repeats another, exactly or nearly, with the smallest doc_id of its group."""
    known = written(sketches(docs), "minhash-sketches")
    known, again = _one_per_id(known)
    folded = known.groupBy("h1", "h2", "n").agg(F.min("doc").alias("doc"), F.first("sketch").alias("sketch"))
    distinct = written(folded, "minhash-distinct")
    copies = known.select("doc", "h1", "h2", "n").join(distinct.select("h1", "h2", "n", F.col("doc").alias("rep")), ["h1", "h2", "n"]).filter("doc <> rep")
    groups = near_groups(docs, distinct, again)
    # A copy's representative may itself have a smaller one.
    copies = copies.join(groups.select(F.col("doc").alias("rep"), F.col("rep").alias("above")), "rep", "left").select("doc", F.coalesce("above", "rep").alias("rep"))
    return copies.unionByName(groups).select(F.col("doc").alias("doc_id"), F.col("rep").alias("rep_id"))


def _one_per_id(known: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """One row for each doc, where rows repeat it that of the smallest (h1, h2, n); and the docs that they repeat with that hash."""
    again = known.groupBy("doc").agg(F.count("*").alias("c"), F.min(F.struct("h1", "h2", "n")).alias("m")).filter("c > 1").select("doc", "m")
    again = written(again, "minhash-again")
    times = again.count()
    if not times:
        return known, None
    once = known.join(small(again.select("doc"), times, 16), "doc", "left_anti")
    more = known.join(small(again, times, 64), "doc").filter("struct(h1, h2, n) = m").drop("m").dropDuplicates(["doc"])
    return written(once.unionByName(more), "minhash-once"), again


def deduplicate(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each group of duplicates, the one of smallest doc_id; columns as they came."""
    dropped = written(duplicate_pairs(docs).select("doc_id"), "minhash-dropped")
    gone, key, own = fresh(docs, "dropped_id", "row_key", "row_set")
    count = dropped.count()
    match = F.col("doc_id").cast("bigint") == F.col(gone)
    kept = docs.join(small(dropped.select(F.col("doc_id").alias(gone)), count, 16), match, "left_anti")
    again = docs.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias(gone)).agg(F.count("*").alias(key)).filter(F.col(key) > 1).select(gone)
    again = written(again, "minhash-repeated")
    times = again.count()
    if not times:
        return kept
    once = kept.join(small(again, times, 16), match, "left_anti")
    more = kept.join(small(again, times, 16), match, "left_semi").withColumn(own, set_hash(F.col("text").cast("string")))
    # Spark limits the groups before they are shuffled, so an id of very many rows is no burden on one task.
    first = W.partitionBy("doc_id").orderBy(F.col(f"{own}.n") == 0, F.col(f"{own}.h1"), F.col(f"{own}.h2"), F.col(f"{own}.n"), F.col("text").isNull(), "text", F.xxhash64(*docs.columns))
    return once.unionByName(more.withColumn(key, F.row_number().over(first)).filter(F.col(key) == 1).select(*docs.columns))
