"""Toxicity from subword-bag embeddings averaged into a linear softmax, trained here in numpy.

A text, in lower case, is a bag of subwords: its character n-grams of NGRAMS lengths, none reaching across white space but with
the space on either side of a word counting as its first or last character, and its whole words. Subwords hash into BUCKETS
vectors of SIZE numbers. Their average, in which those of a word that stands n times weigh log2(1 + n), goes through a linear
softmax over {clean, toxic}; vectors and weights are trained jointly by Adam. A misspelling that was never seen shares most of
its n-grams with words that were.

Every average also has NEUTRAL subwords of vector zero, and the softmax has the fixed margin PRIOR, so a text that shows no
evidence is clean: the fewer subwords a text has, the stronger they must be. The threshold lies above the score of no evidence.

Training takes the labelled documents of lowest hash, at most TRAIN_ROWS of each class: that bound is all that is sampled. What
reaches the driver is each one's distinct words and their counts.
Its rows are weighted so that both classes count alike; the threshold on the toxic probability is set on HELD_OUT of the sample,
kept out of training, where its errors cost least (CLEAN_COST) among those that flag at most FLAGGED of the clean ones.

Since the softmax of an average is linear in the vectors, a text's score needs one number for each bucket: that table is all that
is sent to the executors, and its size is fixed.

Defined cases: null and blank texts score 0 and are not toxic. Null doc_id, repeated rows and nulls elsewhere do not matter: each row is
scored alone. Labels of null doc_id or class, or without a document, are not used; of a doc_id's labels the highest counts, and of
its rows the first in order of text teaches. Where one class or both have no labels nothing can be learned: all scores are 0 and
nothing is toxic. Further columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sortmill.llm._text import mix64, powers64
from sortmill.llm._work import slim_batches, small

NGRAMS, BUCKETS, SIZE = (3, 4, 5), 1 << 18, 8
#: The weight of subwords of vector zero that each average has besides the text's own, and the margin of a text without evidence.
NEUTRAL, PRIOR = 1000.0, -4.0
TRAIN_ROWS, HELD_OUT, EPOCHS, RATE, BATCH = 3000, 0.2, 12, 0.02, 64
#: The threshold is set as if a clean document flagged cost so many toxic ones missed, each as a share of its class.
CLEAN_COST, FLAGGED = 2.0, 0.02
BLOCK = 1 << 20
_BASE, _WORD = 0x9E3779B97F4A7C15, re.compile(r"[^\x00-\x20]+")


def damped(count: np.ndarray) -> np.ndarray:
    """What a word that stands in a text so many times weighs: a text that repeats itself says little more."""
    return np.log2(1.0 + count)


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of the texts, and where they stand.

    Gives for each pair of a text and one of its words the text, the word and how often it stands there; then the subwords' buckets
    of all words and the word that each belongs to.
    """
    none = np.empty(0, np.int64)
    points = np.frombuffer((" " + " ".join(t.lower() for t in texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    edges = np.cumsum([0] + [len(t.lower()) + 1 for t in texts])
    gap = points <= 32
    starts = np.flatnonzero(~gap[1:] & gap[:-1]) + 1
    if not len(starts):
        return none, none, none, none, none
    length = np.flatnonzero(gap[1:] & ~gap[:-1]) + 1 - starts
    own = np.searchsorted(edges, starts - 1, "right") - 1

    def places(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every place of the spans, and its distance from its span's start."""
        pos = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(np.cumsum(size) - size, size)
        return np.repeat(first, size) + pos, pos

    at, pos = places(starts, length)
    hashes = mix64(np.add.reduceat(points[at] * powers64(_BASE + 2, int(length.max()))[pos], np.cumsum(length) - length))
    hashes, first, word = np.unique(hashes, return_index=True, return_inverse=True)
    pairs, count = np.unique(own * len(hashes) + word, return_counts=True)

    # The distinct words side by side, a space between; an n-gram may have one at either end, but none inside.
    size = length[first]
    begin = np.cumsum(size + 1) - size
    line = np.full(int(begin[-1] + size[-1]) + 1, 32, np.uint64)
    to, _ = places(begin, size)
    line[to] = points[places(starts[first], size)[0]]
    holder = np.zeros(len(line), np.int64)
    holder[to] = np.repeat(np.arange(len(hashes)), size)
    gaps = np.concatenate([[0], np.cumsum(line == 32)])
    buckets, owner = [hashes], [np.arange(len(hashes))]
    for n in NGRAMS:
        m = len(line) - n + 1
        if m <= 0:
            continue
        h = np.zeros(m, np.uint64)
        for q, p in enumerate(powers64(_BASE, n)):
            h += line[q : q + m] * p
        place = np.flatnonzero(gaps[n - 1 : n - 1 + m] == gaps[1 : 1 + m])
        buckets.append(mix64(h[place] + np.uint64(n)))
        owner.append(holder[place + 1])
    return pairs // len(hashes), pairs % len(hashes), count, (np.concatenate(buckets) & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate(owner)


def counted(text: str) -> tuple[list[str], list[int]]:
    """The distinct words of a text, in lower case, and how often each stands there."""
    held = Counter(_WORD.findall(text.lower()))
    return list(held), list(held.values())


@dataclass
class Bags:
    """Training texts as words of one vocabulary, and the vocabulary's subwords."""

    #: The words of text i are word[first[i]:first[i + 1]], and each weighs what weight says in the text's average.
    first: np.ndarray
    word: np.ndarray
    weight: np.ndarray
    #: The buckets of word w are bucket[begin[w]:begin[w + 1]].
    begin: np.ndarray
    bucket: np.ndarray

    @staticmethod
    def of(lists: pa.ListArray, counts: pa.ListArray) -> "Bags":
        """From each text's distinct words and their counts."""
        codes = lists.flatten().dictionary_encode()
        word = codes.indices.to_numpy().astype(np.int32)
        begin, bucket = [np.zeros(1, np.int64)], []
        # Words of one block share a call, each as a text of its own.
        size = max(1, BLOCK // 32)
        for i in range(0, len(codes.dictionary), size):
            part = codes.dictionary[i : i + size].to_pylist()
            text, at, _, buckets, owner = words(part)
            order = np.argsort(owner, kind="stable")
            ends = np.cumsum(np.bincount(owner, minlength=len(part)))
            start = ends - np.bincount(owner, minlength=len(part))
            own = np.empty(len(part), np.int64)
            own[text] = at
            spans = [buckets[order[start[w] : ends[w]]] for w in own]
            bucket += [np.concatenate(spans).astype(np.int32)]
            begin.append(begin[-1][-1] + np.cumsum([len(x) for x in spans]))
        begin, bucket = np.concatenate(begin), np.concatenate([np.empty(0, np.int32), *bucket])
        first = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        weight = damped(counts.flatten().to_numpy().astype(np.float64))
        whole = np.concatenate([[0.0], np.cumsum(weight * np.diff(begin)[word])])
        weight /= np.repeat(whole[first[1:]] - whole[first[:-1]] + NEUTRAL, np.diff(first))
        return Bags(first, word, weight.astype(np.float32), begin, bucket)

    @staticmethod
    def of_texts(texts: list[str]) -> "Bags":
        held = [counted(t) for t in texts]
        return Bags.of(pa.array([w for w, _ in held], pa.list_(pa.string())), pa.array([n for _, n in held], pa.list_(pa.int32())))

    def rows(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word of these texts its text (by place in `texts`), the word, and its weight."""
        size = self.first[texts + 1] - self.first[texts]
        at = np.repeat(self.first[texts] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.repeat(np.arange(len(texts)), size), self.word[at], self.weight[at]

    def subwords(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each subword of these words its word (by place in `some`) and its bucket."""
        size = self.begin[some + 1] - self.begin[some]
        at = np.repeat(self.begin[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.repeat(np.arange(len(some)), size), self.bucket[at]

    def margins(self, table: np.ndarray) -> np.ndarray:
        """As `margins` gives for the texts, 0 where that gives nan, without the softmax's own margin."""
        word = np.add.reduceat(table[self.bucket], self.begin[:-1]) if len(self.bucket) else np.zeros(0)
        text, which, weight = self.rows(np.arange(len(self.first) - 1))
        return np.bincount(text, weight * word[which], len(self.first) - 1)


def distinct(values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of integers below `limit`, ascending, and each value's place among them: without a sort."""
    met = np.zeros(limit, bool)
    met[values] = True
    some = np.flatnonzero(met)
    place = np.empty(limit, np.int64)
    place[some] = np.arange(len(some))
    return some, place[values]


def margins(texts: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    """The softmax margin of toxic over clean for each text; nan for a text without subwords."""
    out = np.full(len(texts), np.nan)
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > BLOCK or i == len(texts) - 1:
            text, word, count, buckets, owner = words(texts[start : i + 1])
            n = i + 1 - start
            if len(text):
                sums, subwords = np.bincount(owner, table[buckets]), np.bincount(owner)
                weight = damped(count)
                with np.errstate(invalid="ignore", divide="ignore"):
                    out[start : i + 1] = np.bincount(text, weight * sums[word], n) / np.where(np.bincount(text, minlength=n) > 0, np.bincount(text, weight * subwords[word], n) + NEUTRAL, np.nan) + bias
            start, size = i + 1, 0
    return out


@dataclass
class Model:
    #: What each bucket adds to the margin, before averaging; None if there was nothing to learn from.
    table: np.ndarray | None
    bias: float
    threshold: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """The toxic probability of each text."""
        if self.table is None:
            return np.zeros(len(texts))
        return np.nan_to_num(1.0 / (1.0 + np.exp(-margins(texts, self.table, self.bias))), nan=0.0)


def train(texts: list[str] | Bags, toxic: list[int], seed: int = 6) -> Model:
    """Vectors, softmax weights and threshold from labelled texts."""
    bags = texts if isinstance(texts, Bags) else Bags.of_texts(texts)
    y = np.asarray(toxic, np.int64)
    usable = np.flatnonzero(np.diff(bags.first) > 0)  # the others are blank
    if len(np.unique(y[usable])) < 2:
        return Model(None, PRIOR, 1.0)
    rng = np.random.default_rng(seed)
    held = np.zeros(len(y), bool)
    for c in (0, 1):
        rows = rng.permutation(usable[y[usable] == c])
        held[rows[: int(len(rows) * HELD_OUT)]] = True
    taught = usable[~held[usable]]
    vectors = rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32)
    weights = rng.normal(0, 0.1, (SIZE, 2)).astype(np.float32)
    bias = np.array([-PRIOR / 2, PRIOR / 2], np.float32)
    share = np.bincount(y[taught], minlength=2) / len(taught)
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in (("v", vectors), ("w", weights))}
    met = np.zeros(BUCKETS, bool)
    step = 0

    def adam(name: str, value: np.ndarray, grad: np.ndarray, rows=slice(None)) -> None:
        m, s = state[name]
        m[rows] = 0.9 * m[rows] + 0.1 * grad
        s[rows] = 0.999 * s[rows] + 0.001 * grad * grad
        value[rows] -= RATE * (m[rows] / (1 - 0.9**step)) / (np.sqrt(s[rows] / (1 - 0.999**step)) + 1e-8)

    def sums(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(of, values[:, k], n) for k in range(SIZE)], axis=1).astype(np.float32)

    for _ in range(EPOCHS):
        order = rng.permutation(taught)
        for i in range(0, len(order), BATCH):
            step += 1
            rows = order[i : i + BATCH]
            text, word, part = bags.rows(rows)
            some, at = distinct(word, len(bags.begin) - 1)
            owner, bucket = bags.subwords(some)
            unique, place = distinct(bucket, BUCKETS)
            met[unique] = True
            vector = sums(owner, vectors[bucket], len(some))
            hidden = sums(text, vector[at] * part[:, None], len(rows))
            logit = hidden @ weights + bias
            prob = np.exp(logit - logit.max(axis=1, keepdims=True))
            prob /= prob.sum(axis=1, keepdims=True)
            err = prob
            err[np.arange(len(rows)), y[rows]] -= 1
            err *= (0.5 / share[y[rows]])[:, None].astype(np.float32) / len(rows)
            back = err @ weights.T
            adam("w", weights, hidden.T @ err)
            flow = sums(at, back[text] * part[:, None], len(some))
            adam("v", vectors, sums(place, flow[owner], len(unique)), unique)
    table = (vectors @ (weights[:, 1] - weights[:, 0])).astype(np.float32)
    table[~met] = 0  # buckets that training never met say nothing
    model = Model(table, PRIOR, 0.5)
    rows = np.flatnonzero(held) if len(np.unique(y[held])) == 2 else usable
    score = 1.0 / (1.0 + np.exp(-(bags.margins(table)[rows] + PRIOR)))
    truth = y[rows]
    cuts = np.unique(score)
    cuts = np.concatenate([(cuts[1:] + cuts[:-1]) / 2, [(cuts[-1] + 1.0) / 2]])
    cuts = cuts[(cuts > 1.0 / (1.0 + np.exp(-PRIOR))) & (np.array([np.mean(score[truth == 0] >= c) for c in cuts]) <= FLAGGED)]
    cost = [CLEAN_COST * np.mean(score[truth == 0] >= c) + np.mean(score[truth == 1] < c) for c in cuts]
    best = np.flatnonzero(np.isclose(cost, np.min(cost)))
    model.threshold = float(np.median(cuts[best]))
    return model


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = [counted(t.as_py()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([w for w, _ in held], pa.list_(pa.string())), pa.array([n for _, n in held], pa.list_(pa.int32()))], ["doc", "toxic", "words", "counts"])


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[Bags, list[int]]:
    """At most `rows` labelled texts of each class, those of lowest hash, their words counted where they are read."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("of"), F.col("toxic").cast("int").alias("toxic")).filter("of IS NOT NULL AND toxic IS NOT NULL")
    known = known.groupBy("of").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    first = W.partitionBy("toxic").orderBy(F.xxhash64("of", F.lit(6)), "of")
    known = known.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= rows).select("of", "toxic")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    # 2 * rows of 16 bytes: bounded, whatever the tables hold.
    got = texts.join(small(known, 2 * rows, 16), F.col("doc") == F.col("of")).groupBy("doc").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    got = got.mapInArrow(_count_batches, "doc bigint, toxic int, words array<string>, counts array<int>").toArrow().combine_chunks().sort_by("doc")
    flat = lambda c: pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)
    return Bags.of(flat(got["words"]), flat(got["counts"])), got["toxic"].to_pylist()


def _scorer(shared) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            s = model.scores([t.as_py() or "" for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array(s >= model.threshold if model.table is not None else np.zeros(len(s), bool), pa.bool_())], ["doc_id", "score", "toxic"])

    return score


def score_documents(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, score, toxic) for each row of `docs`."""
    slim_batches(docs.sparkSession)
    model = model or train(*training_rows(docs, labels))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scorer(shared), f"doc_id {kind}, score double, toxic boolean")
