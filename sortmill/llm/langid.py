"""Language identification by prediction by partial matching.

For each language a context tree holds, for each order from 0 to ORDER, the bytes that followed each context of so many bytes in
its training texts, and how often. A byte is coded in the longest context that was seen: with probability count / (total + distinct)
if it followed there, else an escape, distinct / (total + distinct), to the next shorter context, and uniformly over 256 beneath
order 0. The statistics are frozen, so a byte's code length depends on the ORDER bytes before it only, and is rounded once to
2**-20 bits; a text's code length is the exact sum over all its bytes. The language of the shortest code wins.

Trees are grown from the documents of lowest hash in each language, at most TRAIN_ROWS of them: that bound is all that is sampled.
Their size follows from it, and that of what is sent to the executors.

Defined cases: null and empty texts have no language and no bits. Ties go to the language that sorts first. Documents of null lang teach
nothing. Without any labelled text every language is null. Null doc_id, repeated rows and nulls elsewhere do not matter: each row is scored
alone, in whole. Further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sortmill.llm._text import blocks, byte_view
from sortmill.llm._work import slim_batches, small

ORDER, TRAIN_ROWS = 4, 200
UNIT = 1 << 20
#: Grams of which a worker keeps the code lengths at hand. This changes speed only.
KEPT, BLOCK = 1_000_000, 1 << 20
PAD = 10


def grams(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte, it and the ORDER bytes before it as one number; before a text's first byte stand newlines."""
    n = len(offsets) - 1
    place = np.arange(len(raw), dtype=np.int64) + np.repeat(np.arange(1, n + 1, dtype=np.int64) * ORDER, np.diff(offsets))
    padded = np.full(len(raw) + n * ORDER, PAD, np.uint64)
    padded[place] = raw
    g = padded[place]
    for q in range(1, ORDER + 1):
        g = g | padded[place - q] << np.uint64(8 * q)
    return g


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_keys, keys), max(len(sorted_keys) - 1, 0))
    return at, (sorted_keys[at] == keys if len(sorted_keys) else np.zeros(len(keys), bool))


class ContextTree:
    """One language's statistics."""

    def __init__(self, texts: list[str]) -> None:
        raw, offsets = byte_view(pa.array(texts, pa.string()))
        g = grams(raw, offsets)
        self.levels = []
        for order in range(ORDER + 1):
            mask = np.uint64((1 << 8 * (order + 1)) - 1)
            followed, count = np.unique(g & mask, return_counts=True)
            context, first = np.unique(followed >> np.uint64(8), return_index=True)
            total = np.add.reduceat(count, first) if len(first) else count
            distinct = np.diff(np.append(first, len(followed)))
            self.levels.append((followed, count.astype(np.float64), context, total.astype(np.float64), distinct.astype(np.float64)))

    def bits(self, g: np.ndarray) -> np.ndarray:
        """The code length of each gram's last byte, in 1 / UNIT bits."""
        cost = np.zeros(len(g))
        open_ = np.arange(len(g))
        for order in range(ORDER, -1, -1):
            followed, count, context, total, distinct = self.levels[order]
            key = g[open_] & np.uint64((1 << 8 * (order + 1)) - 1)
            at, seen = _find(context, key >> np.uint64(8))
            if not len(context):
                continue
            whole = total[at] + distinct[at]
            to, hit = _find(followed, key)
            cost[open_] += np.where(seen, -np.log2(np.where(hit, count[to], distinct[at]) / whole), 0.0)
            open_ = open_[~hit]
        cost[open_] += 8.0
        return np.rint(cost * UNIT).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    trees: list[ContextTree]
    known: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    lengths: np.ndarray | None = None

    def _lengths(self, g: np.ndarray) -> np.ndarray:
        """The code lengths of distinct grams, a column for each language, from those at hand where they are."""
        if self.lengths is None or len(self.known) > KEPT:
            self.known, self.lengths = np.empty(0, np.uint64), np.empty((0, len(self.trees)), np.int64)
        at, have = _find(self.known, g)
        if not have.all():
            new = np.sort(g[~have])
            cost = np.stack([t.bits(new) for t in self.trees], axis=1)
            to = np.searchsorted(self.known, new)
            self.known, self.lengths = np.insert(self.known, to, new), np.insert(self.lengths, to, cost, axis=0)
            at = np.searchsorted(self.known, g)
        return self.lengths[at]

    def code_lengths(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each text its code length in each language, in 1 / UNIT bits, and its bytes."""
        raw, offsets = byte_view(column)
        out = np.zeros((len(offsets) - 1, len(self.trees)), np.int64)
        for i, j in blocks(offsets, BLOCK):
            o = offsets[i : j + 1] - offsets[i]
            g = grams(raw[offsets[i] : offsets[j]], o)
            if not len(g) or not self.trees:
                continue
            inverse, distinct = pd.factorize(g)
            cost = self._lengths(distinct)
            for k in range(len(self.trees)):
                sums = np.cumsum(cost[:, k][inverse])
                out[i:j, k] = np.diff(np.concatenate([[0], sums])[o])
        return out, np.diff(offsets)


def training_texts(docs: DataFrame, rows: int = TRAIN_ROWS) -> dict[str, list[str]]:
    """For each language at most `rows` texts, those of lowest hash, in that order."""
    labelled = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    labelled = labelled.filter("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    # The hashes are ranked without their texts; rows that repeat one count once.
    first = W.partitionBy("lang").orderBy("h")
    lowest = labelled.select("lang", "h").distinct().withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= rows)
    cut = lowest.groupBy(F.col("lang").alias("of")).agg(F.max("h").alias("cut"))
    got = labelled.join(small(cut, cut.count(), 64), (F.col("lang") == F.col("of")) & (F.col("h") <= F.col("cut"))).groupBy("lang", "h").agg(F.min("text").alias("text")).toPandas()
    return {lang: g.sort_values("h")["text"].tolist() for lang, g in got.groupby("lang")}


def train(texts: dict[str, list[str]]) -> Model:
    languages = sorted(texts)
    return Model(languages, [ContextTree(texts[lang]) for lang in languages])


def _scorer(shared) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, None], object)
        for batch in batches:
            lengths, size = model.code_lengths(batch.column(1))
            if not model.trees:
                best, bits = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            else:
                best = np.where(size > 0, lengths.argmin(axis=1), len(model.languages))
                bits = lengths.min(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(size, pa.int64()), pa.array(bits / UNIT, pa.float64())], ["doc_id", "language", "n_bytes", "bits"])

    return score


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, language, n_bytes, bits) for each row of `docs`; bits is the code length in that language."""
    slim_batches(docs.sparkSession)
    model = model or train(training_texts(docs))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scorer(shared), f"doc_id {kind}, language string, n_bytes bigint, bits double")
