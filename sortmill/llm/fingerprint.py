"""Document fingerprints from prefix polynomial hashes.

For the bytes b of a text and each of two primes p, G[i] is the sum of (b[j] + 1) * BASE**j over j < i, modulo p. The span
[i, i + n) hashes to (G[i + n] - G[i]) / BASE**i; spans are compared by bringing both to the larger power, so no division is
needed. The pair of residues, 62 bits together, answers the equality of any two spans, and binary search over their
lengths gives the longest common extension of two places, forwards or backwards.

`fingerprint_documents` gives each document its fingerprint, the smallest doc_id of the same text, and its relation to an anchor:
the smallest doc_id among the documents that begin with the same ANCHOR bytes (in whole, if shorter). Texts of one fingerprint
and length are compared byte by byte, by an aggregate that has them as its key; where they differ, each is a text of its own.
lcp and lcs are the bytes that it shares with the anchor from the start and from the end. Where lcp + lcs reaches the length of
the shorter of the two, one is the other with a single run of bytes replaced, put in or left out.

Defined cases: null and empty texts have fingerprint and length 0, no anchor, and canonical_id is their own doc_id. Rows of
null doc_id have a fingerprint, but never serve as canonical or anchor. Rows that repeat a doc_id each give a row; the text
that serves for an anchor's doc_id is that of the smallest fingerprint, then length. doc_id must be a whole number, or cast to
one. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sortmill.llm._text import blocks, byte_view
from sortmill.llm._work import slim_batches, small, written

PRIMES, BASES = (2147483647, 2147483629), (1103515245, 1664525021)
ANCHOR = 64
#: Texts that meet their anchor in one place; an anchor of more is sent to several.
PART = 4096
BLOCK = 1 << 20

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(which: int, n: int) -> np.ndarray:
    """BASE**0 .. BASE**(n-1) modulo the prime, at least."""
    have = _powers[which]
    p = np.uint64(PRIMES[which])
    while len(have) < n:
        step = np.uint64(pow(BASES[which], len(have), PRIMES[which]))
        have = np.concatenate([have, have * step % p])
    if len(have) <= 8 * BLOCK:
        _powers[which] = have
    return have


class PrefixHash:
    """Prefix arrays of one byte string."""

    def __init__(self, data: bytes) -> None:
        self.size = len(data)
        b = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
        self.g = []
        for k, prime in enumerate(PRIMES):
            p = np.uint64(prime)
            g = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(b * powers(k, len(b))[: len(b)] % p, out=g[1:])  # below 2**31 each, so 2**33 bytes fit
            self.g.append(g % p)

    def raw(self, k: int, start: int, n: int) -> int:
        """The hash of a span, times BASE**start."""
        g = self.g[k]
        return (int(g[start + n]) - int(g[start])) % PRIMES[k]

    def span(self, start: int, n: int) -> tuple[int, int]:
        """The hash of a span, wherever it stands."""
        return tuple(self.raw(k, start, n) * pow(BASES[k], -start, PRIMES[k]) % PRIMES[k] for k in range(2))

    def fingerprint(self) -> int:
        a, b = (self.raw(k, 0, self.size) for k in range(2))
        return a << 31 | b


def same(a: PrefixHash, i: int, b: PrefixHash, j: int, n: int) -> bool:
    """Whether n bytes of a from i equal those of b from j."""
    if i + n > a.size or j + n > b.size:
        return False
    for k, p in enumerate(PRIMES):
        x, y = a.raw(k, i, n), b.raw(k, j, n)
        if i < j:
            x = x * pow(BASES[k], j - i, p) % p
        else:
            y = y * pow(BASES[k], i - j, p) % p
        if x != y:
            return False
    return True


def common_extension(a: PrefixHash, i: int, b: PrefixHash, j: int) -> int:
    """The bytes that a from i and b from j have in common from there on."""
    low, high = 0, min(a.size - i, b.size - j)
    while low < high:
        n = (low + high + 1) // 2
        if same(a, i, b, j, n):
            low = n
        else:
            high = n - 1
    return low


def common_extension_back(a: PrefixHash, i: int, b: PrefixHash, j: int) -> int:
    """The bytes that a up to i and b up to j have in common, going back."""
    low, high = 0, min(i, j)
    while low < high:
        n = (low + high + 1) // 2
        if same(a, i - n, b, j - n, n):
            low = n
        else:
            high = n - 1
    return low


def _printer(bits: int, with_text: bool = False):
    """Fingerprint, length and anchor hash of each text, from the prefix arrays of many texts laid end to end."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = byte_view(batch.column(1))
            whole, head = np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64)
            sizes = np.diff(offsets)
            for i, j in blocks(offsets, BLOCK):
                o = (offsets[i : j + 1] - offsets[i]).astype(np.int64)
                b = raw[offsets[i] : offsets[j]].astype(np.uint64) + np.uint64(1)
                at = np.arange(len(b), dtype=np.int64) - np.repeat(o[:-1], np.diff(o))
                ends = np.minimum(o[1:], o[:-1] + ANCHOR)
                full, first = [], []
                for k, prime in enumerate(PRIMES):
                    p = np.uint64(prime)
                    g = np.zeros(len(b) + 1, np.uint64)
                    np.cumsum(b * powers(k, int(sizes[i:j].max(initial=1)))[at] % p, out=g[1:])
                    full.append(((g[o[1:]] - g[o[:-1]]) % p).astype(np.int64))
                    first.append(((g[ends] - g[o[:-1]]) % p).astype(np.int64))
                whole[i:j] = full[0] << 31 | full[1]
                head[i:j] = first[0] << 31 | first[1]
            whole &= (1 << bits) - 1
            columns = [batch.column(0), pa.array(sizes.astype(np.int64)), pa.array(whole)]
            if with_text:
                yield pa.RecordBatch.from_arrays([*columns, batch.column(1)], ["doc_id", "n_bytes", "fingerprint", "text"])
            else:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(head)], ["doc_id", "n_bytes", "fingerprint", "head"])

    return prints


def _rows(docs: DataFrame) -> DataFrame:
    slim_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fingerprints(docs: DataFrame, bits: int = 62) -> DataFrame:
    """(doc_id, n_bytes, fingerprint, head): one row for each row of `docs`; head is the hash of the first ANCHOR bytes.

    Of the fingerprint only the low `bits` are given; fewer than 62 serve to test what follows when texts share one.
    """
    return _rows(docs).mapInArrow(_printer(bits), "doc_id bigint, n_bytes bigint, fingerprint bigint, head bigint")


def _texts_of(docs: DataFrame, need: DataFrame, rows: int, bits: int) -> DataFrame:
    """(doc_id, n_bytes, fingerprint, text): the rows of `docs` whose fingerprint and length `need` has."""
    held = _rows(docs).filter(F.octet_length("text") > 0).mapInArrow(_printer(bits, True), "doc_id bigint, n_bytes bigint, fingerprint bigint, text string")
    return held.join(small(need, rows, 32), ["fingerprint", "n_bytes"], "left_semi")


def _extend_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, last_hash = None, None
    for batch in batches:
        lcp, lcs = [], []
        for x, y in zip(batch.column(3), batch.column(4)):
            a, anchor = PrefixHash(x.as_py().encode()), y.as_py()
            if anchor != last:
                last, last_hash = anchor, PrefixHash(anchor.encode())
            n = common_extension(a, 0, last_hash, 0)
            lcp.append(n)
            lcs.append(common_extension_back(a, a.size, last_hash, last_hash.size))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lcp, pa.int64()), pa.array(lcs, pa.int64())], ["fingerprint", "n_bytes", "variant", "lcp", "lcs"])


def _told_apart(docs: DataFrame, prints: DataFrame, held: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """`prints` and `held` with `variant`: 0, or where different texts share a fingerprint and length the text's number among them."""
    shared = written(held.groupBy("fingerprint", "n_bytes").agg(F.count("*").alias("texts")).filter("texts > 1").select("fingerprint", "n_bytes"), "print-shared")
    times = shared.count()
    if not times:
        return prints.withColumn("variant", F.lit(0)), held.withColumn("variant", F.lit(0))
    key = ["fingerprint", "n_bytes"]
    alone = lambda df: df.join(small(shared, times, 32), key, "left_anti").withColumn("variant", F.lit(0))
    some = held.join(small(shared, times, 32), key, "left_semi").withColumn("variant", F.row_number().over(W.partitionBy(*key).orderBy("text")))
    some = written(some, "print-variants")
    rows = _texts_of(docs, shared, times, bits).join(some.select(*key, F.col("text").alias("bytes"), "variant"), key).filter(F.col("text") == F.col("bytes"))
    # Which head is whose is found again from the texts.
    rows = rows.select("doc_id", *key, "variant", "text").mapInArrow(_heads_of, "doc_id bigint, n_bytes bigint, fingerprint bigint, head bigint, variant int")
    return alone(prints).unionByName(rows), alone(held).unionByName(some)


def _heads_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (made,) = _printer(62)(iter([pa.RecordBatch.from_arrays([batch.column(0), batch.column(4)], ["doc_id", "text"])]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(1), made.column(3), batch.column(3)], ["doc_id", "n_bytes", "fingerprint", "head", "variant"])


def fingerprint_documents(docs: DataFrame, bits: int = 62) -> DataFrame:
    """(doc_id, n_bytes, fingerprint, canonical_id, anchor_id, anchor_bytes, lcp, lcs) for each row of `docs`."""
    key, akey = ["fingerprint", "n_bytes"], ["af", "anchor_bytes"]
    prints = written(fingerprints(docs, bits), "prints")
    full = prints.filter("n_bytes > 0")
    # The texts to fetch, each once: those that repeat, to be compared, and those of heads that several share.
    heads = full.groupBy("head").agg(F.count("*").alias("rows")).filter("rows > 1").select("head")
    need = written(full.join(heads, "head", "left_semi").select(*key).distinct(), "print-need")
    held = written(_texts_of(docs, need, need.count(), bits).groupBy(*key, "text").agg(F.count("*").alias("copies")).drop("copies"), "print-held")
    prints, held = _told_apart(docs, prints, held, bits)
    key.append("variant")
    full = prints.filter("n_bytes > 0")
    named = full.filter("doc_id IS NOT NULL")
    # One row for each different text; the extension of a text is that of all its copies.
    texts = full.groupBy(*key).agg(F.min("doc_id").alias("canonical_id"), F.min("head").alias("head"))
    anchors = named.groupBy("head").agg(F.min(F.struct("doc_id", *key)).alias("anchor"), F.count("*").alias("rows"))
    anchors = anchors.select("head", F.col("anchor.doc_id").alias("anchor_id"), F.col("anchor.fingerprint").alias("af"), F.col("anchor.n_bytes").alias("anchor_bytes"), F.col("anchor.variant").alias("av"), F.ceil(F.col("rows") / PART).cast("int").alias("parts"))
    akey.append("av")
    texts = written(texts.join(anchors, "head", "left"), "print-texts")
    own = (F.col("fingerprint") == F.col("af")) & (F.col("n_bytes") == F.col("anchor_bytes")) & (F.col("variant") == F.col("av"))
    pairs = texts.filter(F.col("anchor_id").isNotNull() & ~own)
    spread = pairs.select(*key, *akey, "parts", F.pmod(F.xxhash64(*key), F.col("parts")).cast("int").alias("part"))
    # An anchor goes to as many places as its texts fill, so that none has more of them than PART or so.
    places = pairs.select(*akey, "parts").distinct().select(*akey, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    sent = places.join(held.select(F.col("fingerprint").alias("af"), F.col("n_bytes").alias("anchor_bytes"), F.col("variant").alias("av"), F.col("text").alias("anchor_text")), akey)
    both = spread.join(held, key).join(sent, [*akey, "part"])
    extended = both.select(*key, "text", "anchor_text").mapInArrow(_extend_batches, "fingerprint bigint, n_bytes bigint, variant int, lcp bigint, lcs bigint")
    extended = texts.join(extended, key, "left")
    extended = written(extended.select(*key, "canonical_id", "anchor_id", "anchor_bytes", *(F.coalesce(c, F.when(F.col("anchor_id").isNotNull(), F.col("n_bytes"))).alias(c) for c in ("lcp", "lcs"))), "print-extended")
    out = prints.join(extended, key, "left")
    return out.select("doc_id", "n_bytes", "fingerprint", F.coalesce("canonical_id", F.when(F.col("n_bytes") == 0, F.col("doc_id"))).alias("canonical_id"), "anchor_id", "anchor_bytes", "lcp", "lcs")
