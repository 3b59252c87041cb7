"""Byte-level BPE encoding and decoding by prefix dynamic programming.

The text is cut into pieces by the tokenizer's pattern, and each piece is encoded alone. Of all encodings of a byte string,
BPE gives exactly one; that of each prefix is valid too, so a table holds, for every prefix of a piece, the last token of
its encoding. For the prefix of i bytes it is the one vocabulary entry t that ends there and may follow the last token of
the prefix of i - len(t) bytes, where a pair of tokens may stand side by side if undoing the merges on either side of the
seam never meets a pair that BPE would have merged sooner. The table is filled left to right in linear time; reading it
from the end gives the tokens. Since an entry depends on earlier bytes only, an append keeps the table and adds to it, and an
edit refills it only up to the next piece that the old and the new text share.

Defined cases: a null text has null tokens and counts none; an empty text has no tokens. Strings of special tokens are
ordinary text. Any text decodes to itself. Null doc_id, repeated rows and further columns do not matter: the operator
works row by row and carries them.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sortmill.llm._text import release
from sortmill.llm._work import fresh, slim_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same pattern for the standard library's faster engine, and its classes beside those of PATTERN; where a text has none of the
#: characters on which these differ, both cut it alike.
QUICK = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
_ALIKE = ((r"[^\W\d_]+", r"\p{L}+"), (r"\d+", r"\p{N}+"), (r"(?:[^\s\w]|_)+", r"[^\s\p{L}\p{N}]+"), (r"\s+", r"\s+"))
#: Encodings of pieces, in each of two generations, and pairs of tokens that a worker keeps at hand. This changes speed and memory only.
KEPT_PIECES, KEPT_PAIRS = 150_000, 200_000
#: A match of PATTERN depends on no character more than this far behind its end.
LOOKAHEAD = 2


def _unlike() -> re.Pattern:
    """Finds a character that QUICK and PATTERN put into different classes; all beyond the basic plane count, so that the set is a table."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    differ = np.zeros(len(every), bool)
    for quick, exact in _ALIKE:
        here = np.zeros(len(every), bool)
        for engine, pattern in ((re, quick), (regex, exact)):
            for m in engine.finditer(pattern, every):
                here[m.start() : m.end()] ^= True
        differ |= here
    return re.compile("[" + "".join(re.escape(every[i]) for i in np.flatnonzero(differ)) + "\U00010000-\U0010ffff]")


class Vocabulary:
    """Tokens by rank, the split that makes each, and which may stand side by side."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN) -> None:
        with open(path, "rb") as f:
            ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in f if line.strip()))
        self.tokens = [t for _, t in ranked]
        if [r for r, _ in ranked] != list(range(len(ranked))):
            raise ValueError(f"{path}: ranks have gaps")
        self.index = {t: i for i, t in enumerate(self.tokens)}
        self.sizes = [len(t) for t in self.tokens]
        self.pattern = regex.compile(pattern)
        self._quick, self._unlike = (re.compile(QUICK), _unlike()) if pattern == PATTERN else (None, None)
        self.left, self.right = list(range(len(self.tokens))), list(range(len(self.tokens)))
        self.merged: dict[int, int] = {}
        self._fits: dict[int, bool] = {}
        made = [True] * len(self.tokens)
        for i, t in enumerate(self.tokens):
            if len(t) == 1:
                continue
            for cut in range(1, len(t)):
                a, b = self.index.get(t[:cut], i), self.index.get(t[cut:], i)
                if a < i and b < i and made[a] and made[b] and self._may_follow(a, b):
                    self.left[i], self.right[i] = a, b
                    self.merged[a << 32 | b] = i
                    break
            else:
                made[i] = False  # no sequence of merges leads to it
        self._ends = ahocorasick.Automaton()
        for i, t in enumerate(self.tokens):
            if made[i]:
                self._ends.add_word(t.decode("latin-1"), i)
        self._ends.make_automaton()
        self._whole = {t: i for i, t in enumerate(self.tokens) if not made[i]}

    def _may_follow(self, a: int, b: int) -> bool:
        merged, left, right = self.merged, self.left, self.right
        bound = 1 << 31
        while True:
            if merged.get(a << 32 | b, bound) < bound:
                return False
            # Undo the later of the two outermost merges; what it hides must not have been merged across before it.
            if a > b:
                bound = a
                a = right[a]
                if a == bound:
                    return self._undo_right(a, b)
            else:
                bound = b + 1
                b = left[b]
                if b + 1 == bound:
                    return self._undo_left(a, b)

    def _undo_right(self, a: int, b: int) -> bool:
        """Goes on where a is a single byte: only b can be undone."""
        while True:
            inner = self.left[b]
            if inner == b:
                return True
            bound, b = b + 1, inner
            if self.merged.get(a << 32 | b, bound) < bound:
                return False

    def _undo_left(self, a: int, b: int) -> bool:
        """Goes on where b is a single byte: only a can be undone."""
        while True:
            inner = self.right[a]
            if inner == a:
                return True
            bound, a = a, inner
            if self.merged.get(a << 32 | b, bound) < bound:
                return False

    def may_follow(self, a: int, b: int) -> bool:
        """Whether BPE leaves token b right behind token a."""
        pair = a << 32 | b
        known = self._fits.get(pair)
        if known is None:
            if len(self._fits) >= KEPT_PAIRS:
                self._fits.clear()
            known = self._fits[pair] = self._may_follow(a, b)
        return known

    def split(self, text: str) -> list[str]:
        """The pieces of a text."""
        if self._quick is not None and not self._unlike.search(text):
            return self._quick.findall(text)
        return self.pattern.findall(text)

    def fill(self, piece: bytes, table: array | None = None) -> array:
        """The last token of each prefix of `piece`; `table` holds those of its first bytes, if known."""
        return array("i", self._fill(piece, [] if table is None else table.tolist()))

    def _fill(self, piece: bytes, last: list[int]) -> list[int]:
        sizes, fits = self.sizes, self._fits
        done = len(last)
        # Matches that end behind what is known may begin up to a token's length before.
        begin = max(0, done - 256) if done else 0
        ended = -1
        for end, t in self._ends.iter(piece[begin:].decode("latin-1")):
            end += begin
            if end < done or end == ended:
                continue
            before = end - sizes[t]
            if before >= 0:
                pair = last[before] << 32 | t
                ok = fits.get(pair)
                if ok is None:
                    ok = self.may_follow(last[before], t)
                if not ok:
                    continue
            last.append(t)
            ended = end
        if len(last) != len(piece):
            raise ValueError("the vocabulary lacks a byte of the text")
        return last

    def read(self, last: array | list[int]) -> list[int]:
        """The tokens of a filled table."""
        out, i = [], len(last)
        while i:
            t = last[i - 1]
            out.append(t)
            i -= self.sizes[t]
        out.reverse()
        return out

    def encode_piece(self, piece: str) -> bytes:
        """The tokens of one piece as packed 32-bit integers."""
        raw = piece.encode()
        whole = self.index.get(raw)
        if whole is not None:  # a piece that is a token is encoded as it
            return array("i", [whole]).tobytes()
        return array("i", self.read(self._fill(raw, []))).tobytes()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Pieces(dict):
    """The packed encodings of pieces, made when first asked for; each is decoded again when it is made."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.older: dict[str, bytes] = {}
        #: Pieces of which the encoding does not decode to them: none, if the vocabulary has all bytes.
        self.wrong: set[str] = set()

    def __missing__(self, piece: str) -> bytes:
        made = self.older.get(piece)
        if made is None:
            made = self.vocabulary.encode_piece(piece)
            if self.vocabulary.decode(array("i", made)) != piece.encode():
                self.wrong.add(piece)
        if len(self) >= KEPT_PIECES:
            self.older = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = made
        return made

    def encode(self, text: str) -> np.ndarray:
        return self.checked(text)[0]

    def checked(self, text: str) -> tuple[np.ndarray, bool]:
        """The tokens, and whether they decode to the text: its pieces make it up, and each one's tokens decode to the piece."""
        found = self.vocabulary.split(text)
        ids = np.frombuffer(b"".join(map(self.__getitem__, found)), np.int32)
        return ids, "".join(found) == text and not (self.wrong and any(p in self.wrong for p in found))


_loaded: dict[tuple[str, str], Pieces] = {}


def pieces(path: str = VOCABULARY, pattern: str = PATTERN) -> Pieces:
    """The encoder of a vocabulary file, loaded once in a process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Pieces(Vocabulary(path, pattern))
    return _loaded[path, pattern]


class PrefixTable:
    """A text with its pieces' tables; appends and edits keep what they do not touch."""

    def __init__(self, vocabulary: Vocabulary, text: str = "") -> None:
        self.vocabulary, self.text = vocabulary, ""
        self.starts: list[int] = []
        self.tables: list[array] = []
        #: Bytes whose entries the last change filled.
        self.filled = 0
        self.edit(0, 0, text)

    @staticmethod
    def restored(vocabulary: Vocabulary, text: str, starts: list[int], last: list[int]) -> "PrefixTable":
        """The table that was kept as `starts` and the last tokens of all pieces in a row."""
        out = PrefixTable(vocabulary)
        out.text, out.starts, at = text, list(starts), 0
        for a, b in zip(starts, [*starts[1:], len(text)]):
            n = len(text[a:b].encode())
            out.tables.append(array("i", last[at : at + n]))
            at += n
        return out

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replaces characters start to stop by `new`."""
        old, shift = self.text, len(new) - (stop - start)
        self.text = text = old[:start] + new + old[stop:]
        ends = [*self.starts[1:], len(old)] if self.starts else []
        keep = 0
        while keep < len(ends) and ends[keep] + LOOKAHEAD <= start:
            keep += 1
        at = ends[keep - 1] if keep else 0
        again = {s + shift: k for k, s in enumerate(self.starts) if s >= stop and k >= keep}
        starts, tables, self.filled = [], [], 0
        whole = self.vocabulary._whole
        rest = len(self.starts)
        stale = self.tables[keep] if keep < len(self.tables) else array("i")
        stale_text = old[at : ends[keep]].encode() if keep < len(ends) else b""
        for m in self.vocabulary.pattern.finditer(text, at):
            if m.start() in again and m.start() >= start + len(new):
                rest = again[m.start()]
                break
            raw = m.group().encode()
            if raw in whole:
                table = array("i", [-1] * (len(raw) - 1) + [whole[raw]])
            else:
                # The first piece that is read again may begin as the old one did: those entries hold.
                same = 0
                if stale_text and -1 not in stale:
                    limit = min(len(raw), len(stale_text))
                    while same < limit and raw[same] == stale_text[same]:
                        same += 1
                table = self.vocabulary.fill(raw, stale[:same])
                self.filled += len(raw) - same
            stale_text = b""
            starts.append(m.start())
            tables.append(table)
        self.starts = self.starts[:keep] + starts + [s + shift for s in self.starts[rest:]]
        self.tables = self.tables[:keep] + tables + self.tables[rest:]

    def tokens(self) -> list[int]:
        return [t for table in self.tables for t in self.vocabulary.read(table)]


def encoder(path: str, pattern: str) -> Callable:
    kind = T.StructType([T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("exact", T.BooleanType())])

    @F.arrow_udf(kind)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = pieces(path, pattern)
        for column in batches:
            values, sizes, exact, valid = [], [0], [], []
            for text in column:
                if not text.is_valid:
                    valid.append(False)
                    sizes.append(0)
                    exact.append(None)
                    continue
                text = text.as_py()
                ids, good = held.checked(text)
                values.append(ids)
                sizes.append(len(ids))
                exact.append(good)
                valid.append(True)
            flat = pa.array(np.concatenate(values) if values else np.empty(0, np.int32))
            offsets = np.cumsum(sizes, dtype=np.int64).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat, mask=pa.array([not v for v in valid], pa.bool_()))
            made = pa.StructArray.from_arrays([lists, pa.array(exact, pa.bool_())], ["tokens", "exact"])
            del values, flat, lists
            release()
            yield made

    return encode


def encode_documents(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """`docs` with tokens, n_tokens and exact (whether the tokens decode to the text); such columns that it had are replaced."""
    slim_batches(docs.sparkSession)
    (made,) = fresh(docs, "encoded")
    rows = docs.withColumn(made, encoder(path, pattern)(F.col("text").cast("string")))
    new = {"tokens": F.col(f"{made}.tokens"), "n_tokens": F.coalesce(F.size(f"{made}.tokens"), F.lit(0)), "exact": F.col(f"{made}.exact")}
    old = [docs[c] for c in docs.columns if c.lower() not in new]
    return rows.select(*old, *[v.alias(k) for k, v in new.items()])


def decode_documents(docs: DataFrame, path: str = VOCABULARY, tokens: str = "tokens", text: str = "decoded") -> DataFrame:
    """`docs` with the text that `tokens` stand for, null where they are; bytes that are no UTF-8 become U+FFFD, and an unknown token is an error."""

    @F.arrow_udf(T.StringType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = pieces(path, PATTERN).vocabulary
        for column in batches:
            yield pa.array([None if ids is None else vocabulary.decode(ids).decode("utf-8", "replace") for ids in column.to_pylist()], pa.string())

    slim_batches(docs.sparkSession)
    (made,) = fresh(docs, "made")
    rows = docs.withColumn(made, decode(F.col(tokens)))
    return rows.select(*[docs[c] for c in docs.columns if c.lower() != text.lower()], F.col(made).alias(text))


_STARTS, _LAST = T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("last", T.ArrayType(T.IntegerType()))


def prefix_documents(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """`docs` with `prefix`, each text's prefix table: where its pieces begin, and the last token of each byte prefix of each piece.

    A table takes a number for each byte of the text; it is kept beside texts that will be appended to or edited.
    """

    @F.arrow_udf(T.StructType([_STARTS, _LAST]))
    def fill(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = pieces(path, pattern).vocabulary
        for column in batches:
            made = [None if t is None else PrefixTable(vocabulary, t) for t in column.to_pylist()]
            yield pa.array([None if m is None else {"starts": m.starts, "last": [x for one in m.tables for x in one]} for m in made], pa.struct([("starts", pa.list_(pa.int32())), ("last", pa.list_(pa.int32()))]))

    slim_batches(docs.sparkSession)
    return docs.withColumn("prefix", fill(F.col("text").cast("string")))


def edit_documents(docs: DataFrame, start: str, stop: str, new: str, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """`docs`, which `prefix_documents` made, with the characters from column `start` to column `stop` replaced by column `new`.

    Gives text and prefix as they then are, tokens, n_tokens, and `filled`: the bytes whose entries were filled anew. A null start
    or stop is the text's end, so an append is (null, null, more); places beyond the end are the end. A null `new` changes nothing.
    A null text stays null.
    """
    kind = T.StructType([T.StructField("text", T.StringType()), _STARTS, _LAST, T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("filled", T.IntegerType())])
    arrow = pa.struct([("text", pa.string()), ("starts", pa.list_(pa.int32())), ("last", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32())), ("filled", pa.int32())])

    @F.arrow_udf(kind)
    def edit(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        vocabulary = pieces(path, pattern).vocabulary
        for columns in batches:
            out = []
            for text, prefix, a, b, more in zip(*(c.to_pylist() for c in columns)):
                if text is None or prefix is None:
                    out.append(None)
                    continue
                table = PrefixTable.restored(vocabulary, text, prefix["starts"], prefix["last"])
                table.filled = 0
                if more is not None:
                    a = len(text) if a is None else min(max(a, 0), len(text))
                    b = len(text) if b is None else min(max(b, a), len(text))
                    table.edit(a, b, more)
                out.append({"text": table.text, "starts": table.starts, "last": [x for one in table.tables for x in one], "tokens": table.tokens(), "filled": table.filled})
            yield pa.array(out, arrow)

    slim_batches(docs.sparkSession)
    (made,) = fresh(docs, "edited")
    rows = docs.withColumn(made, edit(F.col("text").cast("string"), F.col("prefix"), F.col(start).cast("int"), F.col(stop).cast("int"), F.col(new).cast("string")))
    fields = {"text": F.col(f"{made}.text"), "prefix": F.when(F.col(made).isNotNull(), F.struct(f"{made}.starts", f"{made}.last")), "tokens": F.col(f"{made}.tokens"), "n_tokens": F.coalesce(F.size(f"{made}.tokens"), F.lit(0)), "filled": F.col(f"{made}.filled")}
    return rows.select(*[docs[c] for c in docs.columns if c.lower() not in fields], *[v.alias(k) for k, v in fields.items()])
