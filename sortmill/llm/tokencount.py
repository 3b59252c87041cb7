"""Exact token counts, huge documents being encoded in overlapping chunks that are spliced where they resynchronise.

A text of at most CHUNK characters is encoded whole. A longer one is cut into chunks of CHUNK characters, each reaching
OVERLAP characters into the next, so that any number of tasks can share it. Each chunk is encoded as if the text began there.
The tokenizer's pattern looks only forward: once a piece begins at the same place in two chunks, all further pieces are
the same, up to LOOKAHEAD characters before the earlier chunk's end. So a chunk that is known to be right from some place on hands over
to the next at the first place in their overlap where both begin a piece, and that splice is exact. A document with an
overlap where the two never agree (within one very long piece, say) is encoded again with chunks and overlaps WIDEN
times as wide, until all of its seams hold or one chunk is the whole text.

Defined cases: null and empty texts have 0 tokens. Equal texts are encoded once if huge. Null doc_id, repeated rows and nulls
elsewhere do not matter: each row has its count. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortmill.llm import bpe
from sortmill.llm._work import slim_batches, small, written

CHUNK, OVERLAP, WIDEN = 1 << 15, 128, 4


def _digest(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def _counter(path: str, pattern: str, chunk: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bpe.pieces(path, pattern)
        for batch in batches:
            counts, digests = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                if len(text) > chunk:
                    counts.append(None)
                    digests.append(_digest(text))
                else:
                    counts.append(len(held.encode(text)))
                    digests.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_tokens", "digest"])

    return count


def _cutter(chunk: int, overlap: int) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                for k, at in enumerate(range(0, len(text), chunk)):
                    piece = text[at : at + chunk + overlap]
                    yield pa.RecordBatch.from_arrays([pa.array([digest]), pa.array([k], pa.int32()), pa.array([at], pa.int64()), pa.array([len(text)], pa.int64()), pa.array([piece])], ["digest", "k", "at", "size", "piece"])

    return cut


def encode_chunk(held: bpe.Pieces, piece: str, at: int, size: int, chunk: int, overlap: int) -> tuple[list[int], list[int], int]:
    """Where pieces begin in the chunk's two overlaps, the tokens before each of those, and the chunk's tokens in all.

    Of the second overlap, only the beginnings that no character beyond the chunk could change are given.
    """
    found = held.vocabulary.split(piece)
    starts = at + np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
    before = np.concatenate([[0], np.cumsum([len(held[x]) // 4 for x in found])]).astype(np.int64)
    end = at + len(piece)
    sure = starts <= (end if end == size else end - bpe.LOOKAHEAD)
    near = (starts <= at + overlap) | (starts >= at + chunk)
    return starts[sure & near].tolist(), before[sure & near].tolist(), int(before[-1])


def splice(chunks: list[tuple[int, int, list[int], list[int], int]], size: int) -> int | None:
    """The tokens of a text of `size` characters from its chunks (at, end, starts, before, total) in order; None if a seam fails."""
    at, end, starts, before, total = chunks[0]
    place, counted = 0, 0
    here = dict(zip(starts, before))
    base = here.get(place, 0)
    for nxt in chunks[1:]:
        if end == size:
            break
        there = dict(zip(nxt[2], nxt[3]))
        seam = next((s for s in sorted(here) if s >= max(place, nxt[0]) and s in there), None)
        if seam is None:
            return None
        counted += here[seam] - base
        place, here, base = seam, there, there[seam]
        at, end, starts, before, total = nxt
    return counted + total - base


def _encoder(path: str, pattern: str, chunk: int, overlap: int) -> Callable:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bpe.pieces(path, pattern)
        for batch in batches:
            cols = batch.to_pydict()
            out = [encode_chunk(held, p, a, s, chunk, overlap) for p, a, s in zip(cols["piece"], cols["at"], cols["size"])]
            ends = [a + len(p) for p, a in zip(cols["piece"], cols["at"])]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(ends, pa.int64()), batch.column(3), pa.array([o[0] for o in out], longs), pa.array([o[1] for o in out], longs), pa.array([o[2] for o in out], pa.int64())],
                ["digest", "k", "at", "finish", "size", "starts", "before", "total"],
            )

    return encode


def _splice_group(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("k")
    chunks = [(r.at, r.finish, list(r.starts), list(r.before), r.total) for r in group.itertuples(index=False)]
    count = splice(chunks, int(group["size"].iloc[0]))
    return pd.DataFrame({"digest": [group["digest"].iloc[0]], "spliced": pd.array([count], "Int64")})


def count_documents(docs: DataFrame, path: str = bpe.VOCABULARY, pattern: str = bpe.PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_tokens) for each row of `docs`."""
    slim_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = written(rows.mapInArrow(_counter(path, pattern, chunk), f"doc_id {kind}, n_tokens bigint, digest string"), "count-rows")
    huge = rows.filter(F.length("text") > chunk).select(F.md5(F.col("text").cast("binary")).alias("digest"), "text")
    pending = counts.filter("digest IS NOT NULL").select("digest").distinct()
    left, done = pending.count(), []
    while left:
        # Only what is still open is cut again. Spread over tasks by (document, chunk): one huge document is the work of many.
        cut = huge.join(small(pending, left, 64), "digest", "left_semi").select("digest", "text")
        cut = cut.mapInArrow(_cutter(chunk, overlap), "digest string, k int, at bigint, size bigint, piece string").dropDuplicates(["digest", "k"])
        seen = cut.select("digest", "k", "at", "size", "piece").mapInArrow(_encoder(path, pattern, chunk, overlap), "digest string, k int, at bigint, finish bigint, size bigint, starts array<bigint>, before array<bigint>, total bigint")
        spliced = written(seen.groupBy("digest").applyInPandas(_splice_group, "digest string, spliced bigint"), "count-spliced")
        done.append(spliced.filter("spliced IS NOT NULL"))
        pending = spliced.filter("spliced IS NULL").select("digest")
        left = pending.count()
        chunk, overlap = chunk * WIDEN, overlap * WIDEN * WIDEN
        overlap = min(overlap, chunk)
    if not done:
        return counts.select("doc_id", "n_tokens")
    spliced = done[0]
    for more in done[1:]:
        spliced = spliced.unionByName(more)
    spliced = written(spliced, "count-huge")
    out = counts.join(small(spliced, spliced.count(), 64), "digest", "left")
    return out.select("doc_id", F.coalesce("n_tokens", "spliced").alias("n_tokens"))
