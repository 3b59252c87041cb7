"""Removal of passages of several lines that documents share, found as content-defined chunks of lines.

A text of more than one line is its lines, parted by U+000A. The rolling hash at a line covers it and the line before. Where that
hash recurs in the corpus, the two lines stand together elsewhere too, and a chunk is a maximal run of such pairs that follows
one earlier place line by line: its boundaries are where the rolling hash stops recurring there. So they depend on the lines of
the passage alone, wherever it stands, and a passage of two lines is found as well as one of forty; boundaries drawn at a
share of the hashes would strand the lines beside them. A line of LONG bytes is a chunk by itself too.

1. Each pair, and each long line, that occurs more than once is compared byte by byte with the others of its hash; its first is
   the one that comes first in order of (doc_id, digest of the text, place).
2. Pairs that are not first and follow each other as their firsts do make a chunk; it needs MIN_BYTES.
3. The lines of such chunks go, but for those that are a first of what goes elsewhere: each passage stays once, in one piece.

Defined cases: null and empty texts, and texts of one line, stay as they are. A document of which nothing is left goes. A document is a
doc_id and text: rows that repeat both count once, and what one keeps all keep; rows that repeat the doc_id alone are further
documents. Null doc_ids come after all others. n_chars, if there is such a column, is the new length of a changed text. Further
columns are carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from sortmill.llm._text import mix64, release
from sortmill.llm._work import fresh, slim_batches, small, written

MIN_BYTES, LONG = 64, 256
_BASE = np.uint64(0x9E3779B97F4A7C15)


def digest(text: Column) -> Column:
    """The first 60 bits of an MD5, as an integer."""
    return F.conv(F.substring(F.md5(text.cast("string").cast("binary")), 1, 15), 16, 10).cast("bigint")


def rolling(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of a text's lines: first line, number of lines, and 128-bit hash (two columns) of each pair and each long line."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    one = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), np.uint64).reshape(-1, 2)
    two = mix64(one[:-1] * _BASE + one[1:])
    long = np.flatnonzero(size >= LONG)
    place = np.concatenate([np.arange(len(two)), long])
    wide = np.concatenate([np.full(len(two), 2), np.full(len(long), 1)])
    return place, wide, np.concatenate([two, mix64(one[long])]).view(np.int64)


def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [rolling(t.as_py().encode().split(b"\n")) for t in batch.column(2)]
        own = pa.array(np.repeat(np.arange(len(made)), [len(m[0]) for m in made]))
        flat = lambda k: np.concatenate([m[k] for m in made]) if made else np.empty((0, 2) if k == 2 else 0, np.int64)
        key = flat(2)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(own), batch.column(1).take(own), pa.array(flat(0), pa.int32()), pa.array(flat(1), pa.int32()), pa.array(key[:, 0].copy(), pa.int64()), pa.array(key[:, 1].copy(), pa.int64())],
            ["doc", "dg", "place", "wide", "k1", "k2"],
        )


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of each text that `spots` names by place and width, with their bytes as text and the size of their last line."""
    names = ["doc", "dg", "place", "wide", "k1", "k2", "tail", "chunk"]
    kinds = [None, pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
    for batch in batches:
        out, held = [[] for _ in names], 0
        docs = batch.column(0)

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k or docs.type) for x, k in zip(out, kinds)], names)

        for doc, dg, text, spots in zip(docs.to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            lines = text.as_py().encode().split(b"\n")
            place, wide, key = rolling(lines)
            wanted = np.isin(place * 2 + wide - 1, spots.values.to_numpy())
            for p, w, (k1, k2) in zip(place[wanted].tolist(), wide[wanted].tolist(), key[wanted].tolist()):
                chunk = b"\n".join(lines[p : p + w]).decode()
                for x, v in zip(out, (doc, dg, p, w, k1, k2, len(lines[p + w - 1]), chunk)):
                    x.append(v)
                held += len(chunk)
                if held > 4 << 20:
                    yield made()
                    out, held = [[] for _ in names], 0
        yield made()
        release()


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").alias("doc"), text.alias("text")).filter(F.instr("text", "\n") > 0).select("doc", digest(F.col("text")).alias("dg"), "text")


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc, dg, place, wide, k1, k2, tail, chunk): the windows that occur more than once, by hash."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    all_ = written(_texts(docs).mapInArrow(_window_batches, f"doc {kind}, dg bigint, place int, wide int, k1 bigint, k2 bigint"), "lines-windows")
    again = written(all_.groupBy("k1", "k2").agg(F.count("*").alias("times")).filter("times > 1").select("k1", "k2"), "lines-again")
    met = all_.join(small(again, again.count(), 64), ["k1", "k2"])
    spots = written(met.groupBy("doc", "dg").agg(F.collect_set(F.col("place") * 2 + F.col("wide") - 1).alias("spots")), "lines-spots")
    size = spots.select(F.sum(F.size("spots") * 8 + 96)).first()[0] or 0
    spots = spots.select(F.col("doc").alias("of"), F.col("dg").alias("of_dg"), "spots")
    texts = _texts(docs).join(small(spots, 1, size), F.col("doc").eqNullSafe(F.col("of")) & (F.col("dg") == F.col("of_dg"))).select("doc", "dg", "text", "spots")
    return written(texts.mapInArrow(_text_batches, f"doc {kind}, dg bigint, place int, wide int, k1 bigint, k2 bigint, tail int, chunk string"), "lines-held")


def repeats(docs: DataFrame) -> DataFrame:
    """(doc, dg, low, high, first_doc, first_dg, first_low, first_high): the chunks and where each stands first, in lines from 0."""
    held = occurrences(docs)
    at = F.struct(F.col("doc").isNull().alias("unnamed"), "doc", "dg", "place")
    first = held.groupBy("k1", "k2", "chunk").agg(F.min(at).alias("first"), F.count("*").alias("times")).filter("times > 1").select("k1", "k2", F.col("chunk").alias("bytes"), "first")
    later = held.join(first, ["k1", "k2"]).filter((F.col("chunk") == F.col("bytes")) & ~(at == F.col("first")))
    later = later.select("doc", "dg", "place", "wide", "tail", F.octet_length("chunk").alias("size"), F.col("first.doc").alias("first_doc"), F.col("first.dg").alias("first_dg"), F.col("first.place").alias("first_place")).distinct()
    shift = (F.col("place") - F.col("first_place")).alias("shift")
    along = ["doc", "dg", "first_doc", "first_dg", "wide", "shift"]
    run = F.col("place") - F.row_number().over(W.partitionBy(*along).orderBy("place"))
    runs = later.withColumn("shift", shift).withColumn("run", run).groupBy(*along, "run")
    head = F.min_by(F.col("size") - F.col("tail") - 1, "place")
    runs = runs.agg(F.min("place").alias("low"), (F.max("place") + F.col("wide") - 1).alias("high"), (F.sum(F.col("tail") + 1) + head).alias("size"))
    found = runs.filter(F.col("size") >= MIN_BYTES)
    return written(found.select("doc", "dg", "low", "high", "first_doc", "first_dg", (F.col("low") - F.col("shift")).alias("first_low"), (F.col("high") - F.col("shift")).alias("first_high")), "lines-chunks")


def _merged(spans: DataFrame) -> DataFrame:
    """(doc, dg, kept, low, high): spans that overlap as one, so that a document has no more of them than lines."""
    mine = W.partitionBy("doc", "dg", "kept").orderBy("low", "high")
    opens = F.col("low") > F.coalesce(F.max("high").over(mine.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))
    runs = spans.withColumn("opens", opens).withColumn("run", F.sum(F.col("opens").cast("int")).over(mine))
    return runs.groupBy("doc", "dg", "kept", "run").agg(F.min("low").alias("low"), F.max("high").alias("high"))


@F.arrow_udf(T.StringType())
def _rewritten(text: pa.Array, gone: pa.Array, kept: pa.Array) -> pa.Array:
    out = []
    for t, g, k in zip(text, gone, kept):
        if not t.is_valid:
            out.append(None)
            continue
        lines = t.as_py().split("\n")
        keep = np.ones(len(lines), bool)
        for spans, value in ((g, False), (k, True)):
            for x in spans.as_py():
                keep[x["low"] : x["high"] + 1] = value
        left = [lines[i] for i in np.flatnonzero(keep)]
        out.append("\n".join(left) if left else None)
    return pa.array(out, pa.string())


def remove_repeats(docs: DataFrame) -> DataFrame:
    """`docs` without the lines of the chunks that `repeats` names."""
    slim_batches(docs.sparkSession)
    key, dg, gone, kept, new = fresh(docs, "gone_doc", "gone_dg", "gone", "kept", "new_text")
    found = repeats(docs)
    spans = found.select("doc", "dg", F.lit(False).alias("kept"), "low", "high").unionByName(found.select(F.col("first_doc").alias("doc"), F.col("first_dg").alias("dg"), F.lit(True).alias("kept"), F.col("first_low").alias("low"), F.col("first_high").alias("high")).distinct())
    span = F.struct("low", "high")
    lists = _merged(spans).groupBy(F.col("doc").alias(key), F.col("dg").alias(dg)).agg(F.collect_list(F.when(~F.col("kept"), span)).alias(gone), F.collect_list(F.when(F.col("kept"), span)).alias(kept)).filter(F.size(gone) > 0)
    lists = written(lists, "lines-gone")
    size = lists.select(F.sum((F.size(gone) + F.size(kept)) * 32 + 160)).first()[0] or 0
    text = F.col("text").cast("string")
    rows = docs.join(small(lists, 1, size), F.col("doc_id").eqNullSafe(F.col(key)) & (digest(text) == F.col(dg)), "left")
    touched = F.col(gone).isNotNull()
    rows = rows.withColumn(new, _rewritten(F.when(touched, text), F.col(gone), F.col(kept)))
    rows = rows.filter(~touched | F.col(new).isNotNull())
    out = []
    for c, kind in docs.dtypes:
        if c == "text":
            out.append(F.when(touched, F.col(new)).otherwise(docs[c].cast("string")).alias(c))
        elif c == "n_chars":
            out.append(F.when(touched, F.length(new).cast(kind)).otherwise(docs[c]).alias(c))
        else:
            out.append(docs[c])
    return rows.select(*out)


SQL = f"""
WITH numbered AS (SELECT row_number() OVER () AS rid, doc_id, text, n_chars, ('0x' || substr(md5(text), 1, 15))::BIGINT AS dg FROM documents),
whole AS (SELECT DISTINCT doc_id, dg, text FROM numbered WHERE contains(text, chr(10))),
split AS (SELECT doc_id, dg, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM whole),
pairs AS (SELECT doc_id, dg, pos - 1 AS place, 2 AS wide, lag(line) OVER (PARTITION BY doc_id, dg ORDER BY pos) || chr(10) || line AS chunk, strlen(line) AS tail FROM split),
windows AS (SELECT * FROM pairs WHERE place >= 0 UNION ALL SELECT doc_id, dg, pos, 1, line, strlen(line) FROM split WHERE strlen(line) >= {LONG}),
ranked AS (SELECT *, first_value(doc_id) OVER w AS fd, first_value(dg) OVER w AS fg, first_value(place) OVER w AS fp, row_number() OVER w AS nth FROM windows WINDOW w AS (PARTITION BY chunk, wide ORDER BY doc_id NULLS LAST, dg, place)),
later AS (SELECT *, place - fp AS shift, place - row_number() OVER (PARTITION BY doc_id, dg, fd, fg, wide, place - fp ORDER BY place) AS run FROM ranked WHERE nth > 1),
chunks AS (SELECT doc_id, dg, fd, fg, min(place) AS low, max(place) + wide - 1 AS high, min(fp) AS flow, max(fp) + wide - 1 AS fhigh FROM later GROUP BY doc_id, dg, fd, fg, wide, shift, run HAVING sum(tail + 1) + arg_min(strlen(chunk) - tail - 1, place) >= {MIN_BYTES}),
gone AS (SELECT DISTINCT doc_id, dg, unnest(range(low, high + 1)) AS pos FROM chunks),
kept AS (SELECT DISTINCT fd, fg, unnest(range(flow, fhigh + 1)) AS pos FROM chunks),
lost AS (SELECT g.doc_id, g.dg, g.pos FROM gone g LEFT JOIN kept k ON g.doc_id IS NOT DISTINCT FROM k.fd AND g.dg = k.fg AND g.pos = k.pos WHERE k.fg IS NULL),
left_over AS (SELECT s.doc_id, s.dg, string_agg(line, chr(10) ORDER BY s.pos) FILTER (l.dg IS NULL) AS new_text, count(l.dg) AS lines FROM split s LEFT JOIN lost l ON s.doc_id IS NOT DISTINCT FROM l.doc_id AND s.dg = l.dg AND s.pos = l.pos GROUP BY s.doc_id, s.dg)
SELECT d.doc_id, CASE WHEN lines > 0 THEN new_text ELSE text END AS text, CASE WHEN lines > 0 THEN length(new_text) ELSE n_chars END AS n_chars
FROM numbered d LEFT JOIN left_over l ON d.doc_id IS NOT DISTINCT FROM l.doc_id AND d.dg = l.dg WHERE lines IS NULL OR lines = 0 OR new_text IS NOT NULL"""
