"""An inverted index of words and search over it. Built-in functions but for the sorting of the stored index, which is done in Arrow batches.

The index is written once, as runs sorted by word; a search reads the row groups of its terms in each. `search` tests the texts
themselves instead, for a table that is searched once.

A null text has no words. Rows of one document id are one document: a word's `postings` hold it once, a stored index holds it for
each row and run, which the searches unite. Search words are taken as they are, case and all, unless asked to be tokenised as the index was; a repeated
word counts once, an empty query finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sortmill import shared

SEPARATORS, RULES = r"""[-*()"'\[\]:\s?.,]+""", r"""([-"':+_=/|]{3,})"""


def words(text: Column) -> Column:
    """Lower-cased words; runs of three or more rule characters vanish from inside them."""
    cleaned = F.transform(F.split(text, SEPARATORS), lambda w: F.lower(F.regexp_replace(w, RULES, "")))
    return F.filter(cleaned, lambda w: w != "")


def occurrences(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, word), one row per occurrence."""
    return docs.select(doc, F.explode(words(F.col(text))).alias("word"))


def postings(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, doc, freq)."""
    return occurrences(docs, doc, text).groupBy("word", doc).agg(F.count("*").alias("freq"))


def positions(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, doc, at): every occurrence with its place from 0."""
    return docs.select(doc, F.posexplode(words(F.col(text))).alias("at", "word")).select("word", doc, "at")


def postings_of_words(docs: DataFrame, doc: str, listed: str) -> DataFrame:
    """`postings` of documents that come as lists of words."""
    return docs.select(doc, F.explode(listed).alias("word")).groupBy("word", doc).agg(F.count("*").alias("freq"))


def word_counts(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, numwords) for each row that has words; each row is counted alone, without a shuffle, if doc is a key."""
    return docs.select(doc, F.size(words(F.col(text))).cast("bigint").alias("numwords")).filter("numwords > 0")


def search(docs: DataFrame, terms: list[str], doc: str = "doc_id", text: str = "text", after: int | None = None) -> DataFrame:
    """The documents that hold all terms, each once; `after` skips to those with a greater id.

    Each text is tested where it is read; only the ids of hits are shuffled, to be made distinct.
    """
    terms = list(dict.fromkeys(terms))
    held = words(F.col(text))
    hit = F.lit(bool(terms))
    for t in terms:
        hit = hit & F.array_contains(held, t)
    rows = docs.filter(F.col(text).isNotNull() & hit)
    if after is not None:
        rows = rows.filter(F.col(doc) > after)
    return rows.select(doc).distinct()


#: A sorted run of the index holds so many occurrences or bytes of them: what a task keeps in memory, whatever it reads.
RUN, RUN_BYTES = 1 << 21, 64 << 20


def _run(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of occurrences (word, doc, at), which come text by text, each text's from place 0: sorted by word, texts in their order."""
    rows = pa.Table.from_batches(held).combine_chunks()
    word, doc, at = (c.chunk(0) for c in rows.columns)
    coded, places = word.dictionary_encode(), at.to_numpy()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int32)
    rank[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
    code = rank[coded.indices.to_numpy()]
    by_word = np.argsort(code.astype(np.uint16) if len(order) <= 1 << 16 else code, kind="stable")
    code, nth = code[by_word], np.cumsum(places == 0)[by_word]
    first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (nth[1:] != nth[:-1])]))
    ends = np.append(first, len(code)).astype(np.int32)
    out = pa.RecordBatch.from_arrays(
        [
            coded.dictionary.take(order).take(pa.array(code[first])),
            doc.take(pa.array(by_word[first])),
            pa.array(np.diff(ends).astype(np.int64)),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(places[by_word])),
        ],
        names=[*rows.column_names[:2], "freq", "at"],
    )
    for k in range(0, out.num_rows, 1 << 16):
        yield out.slice(k, 1 << 16)


def sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n, size = [], 0, 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n, size = n + b.num_rows, size + b.nbytes
        if n >= RUN or size >= RUN_BYTES:
            yield from _run(held)
            held, n, size = [], 0, 0
    if held:
        yield from _run(held)


def write_index(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text") -> None:
    """The postings with positions, (word, doc, freq, at), each task's as one file of runs sorted by word: a search reads few pages of each.

    Nothing is shuffled or spilled: a task sorts one run at a time in memory. A text that ends a run may go on in the next.
    """
    placed = positions(docs, doc, text)
    schema = T.StructType([*placed.schema.fields[:2], T.StructField("freq", T.LongType()), T.StructField("at", T.ArrayType(T.IntegerType()))])
    placed.mapInArrow(sorted_runs, schema).write.option("compression", "zstd").option("parquet.block.size", str(8 << 20)).parquet(path)


_indexes: dict[tuple, str] = {}


def stored_index(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of the files that `docs` reads, written to the shared folder when first asked for and read from there afterwards.

    It is known by those files' names, sizes and times: where they change it is made again.
    """
    spark = docs.sparkSession
    files = []
    for f in sorted(docs.inputFiles()):
        at, fs = shared.path_of(spark, f)
        state = fs.getFileStatus(at)
        files.append((f, state.getLen(), state.getModificationTime()))
    key = (spark.sparkContext.applicationId, tuple(files), doc, text)
    if key not in _indexes:
        path = shared.fresh_path(spark, "text-index")
        write_index(docs, path, doc, text)
        _indexes[key] = path
    return spark.read.parquet(_indexes[key])


def _terms_of(index: DataFrame, terms: list[str], *columns: str) -> DataFrame:
    return index.filter(F.col("word").isin(terms)).select("word", *columns)


def search_postings(index: DataFrame, terms: list[str], doc: str = "doc_id", after: int | None = None) -> DataFrame:
    """As `search`, over a stored index: its rows of the terms only, pruned by word, and one aggregate."""
    terms = list(dict.fromkeys(terms))
    hits = _terms_of(index, terms, doc)
    if after is not None:
        hits = hits.filter(F.col(doc) > after)
    (ok,) = shared.fresh(hits, "ok")
    every = reduce(lambda ok, t: ok & F.max(F.col("word") == t), terms, F.lit(bool(terms)))
    return hits.groupBy(doc).agg(every.alias(ok)).filter(ok).select(doc)


def search_any(index: DataFrame, terms: list[str], doc: str = "doc_id", without: list[str] = ()) -> DataFrame:
    """The documents that hold any of the terms and none of `without`."""
    without = list(dict.fromkeys(without))
    rows = _terms_of(index, list(dict.fromkeys([*terms, *without])), doc)
    found = rows.groupBy(doc).agg(F.max(F.col("word").isin(without) if without else F.lit(False)).alias("bad"), F.max(F.col("word").isin(list(terms))).alias("good"))
    return found.filter("good AND NOT bad").select(doc)


def _before(k: int, place: Column) -> Column:
    return place - k


def search_near(index: DataFrame, terms: list[str], within: int | None = None, doc: str = "doc_id") -> DataFrame:
    """The documents with the terms as a phrase; or, if `within` is given, with all of them inside so many words, in any order."""
    distinct = list(dict.fromkeys(terms))
    rows = _terms_of(index, distinct, doc, "at").groupBy(doc, "word").agg(F.flatten(F.collect_list("at")).alias("at"))
    rows = rows.groupBy(doc).agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("held"))
    rows = rows.filter(F.size("held") == len(distinct)).filter(F.lit(bool(distinct)))
    places = lambda t: F.element_at("held", F.lit(t))
    if within is None:
        # The places where the phrase could begin, term after term.
        starts = places(terms[0]) if terms else F.array()
        for k, t in enumerate(terms[1:], 1):
            starts = F.array_intersect(starts, F.transform(places(t), partial(_before, k)))
        return rows.filter(F.size(starts) > 0).select(doc)
    # A window that begins at some term's place, and holds one of each.
    all_places = F.flatten(F.array(*[places(t) for t in distinct]))
    inside = lambda s: reduce(lambda ok, t: ok & F.exists(places(t), lambda p: (p >= s) & (p < s + within)), distinct, F.lit(True))
    return rows.filter(F.exists(all_places, inside)).select(doc)


def tf_idf(index: DataFrame, terms: list[str], documents: int, doc: str = "doc_id") -> DataFrame:
    """(doc, score): the sum over the terms of freq * ln(documents / documents with the term)."""
    rows = _terms_of(index, list(dict.fromkeys(terms)), doc, "freq").groupBy("word", doc).agg(F.sum("freq").alias("freq"))
    seen = rows.groupBy("word").agg(F.count("*").alias("df"))  # one row a term
    weight = F.col("freq") * F.ln(F.lit(float(documents)) / F.col("df"))
    return rows.join(F.broadcast(seen), "word").groupBy(doc).agg(F.sum(weight).alias("score"))


def query_terms(expression: str, normalise: bool = False) -> list[str]:
    """The terms of a query, parted by white space; `normalise` treats them as the index treats text."""
    import re

    if not normalise:
        return expression.split()
    return [w for w in (re.sub(RULES, "", x).lower() for x in re.split(SEPARATORS, expression)) if w]
