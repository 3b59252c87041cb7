"""Hierarchical typed keys: lists of parts that compare part by part, a prefix before what it begins.

A part is a LONG, STRING, RECORD_KEY (nested key), RAW_BYTES or TS_ATTRIBUTE; parts of different types compare by type.
Where a key's shape is fixed, plain columns in order say the same and are pruned by Parquet statistics. Where it is not,
`encode` gives a BINARY whose unsigned byte order is the key order, so a range or prefix scan is a range of one column.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG, STRING, RECORD_KEY, RAW_BYTES, TS_ATTRIBUTE = 1, 2, 10, 11, 40
_ZERO, _ZERO_ONE, _END = "\x00", "\x00\x01", "\x00\x00"


def _tag(tag: int) -> Column:
    return F.lit(bytes([tag]))


def _escaped(b: Column) -> Column:
    """Bytes with 00 written as 00 01 and 00 00 at the end, so that no part is a prefix of another."""
    wide = F.decode(b, "ISO-8859-1")
    return F.encode(F.concat(F.replace(wide, F.lit(_ZERO), F.lit(_ZERO_ONE)), F.lit(_END)), "ISO-8859-1")


def _fixed(tag: int, c: Column) -> Column:
    flipped = c.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))
    return F.concat(_tag(tag), F.unhex(F.lpad(F.hex(flipped), 16, "0")))


def long_part(c: Column) -> Column:
    return _fixed(LONG, c)


def version_part(c: Column) -> Column:
    return _fixed(TS_ATTRIBUTE, c)


def string_part(c: Column) -> Column:
    return F.concat(_tag(STRING), _escaped(c.cast("string").cast("binary")))


def bytes_part(c: Column) -> Column:
    return F.concat(_tag(RAW_BYTES), _escaped(c.cast("binary")))


def nested_part(key: Column) -> Column:
    return F.concat(_tag(RECORD_KEY), _escaped(key))


def encode(*parts: Column) -> Column:
    """The key of encoded parts. A null part makes a null key."""
    return F.concat(*parts)


def after_prefix(key: Column) -> Column:
    """Above every key that begins with `key`, below all greater ones: no part's type is FF."""
    return F.concat(key, F.lit(b"\xff"))


def in_prefix(key: Column, prefix: Column) -> Column:
    """Whether `key` begins with `prefix`; a range, which reaches the scan where `prefix` is a literal."""
    return (key >= prefix) & (key < after_prefix(prefix))


def decode(key: bytes) -> list:
    """The parts of an encoded key as Python values; TS_ATTRIBUTE and RECORD_KEY parts as (type, value)."""
    out, i = [], 0
    while i < len(key):
        tag = key[i]
        i += 1
        if tag in (LONG, TS_ATTRIBUTE):
            (raw,) = struct.unpack(">Q", key[i : i + 8])
            i += 8
            value = raw - (1 << 63)
            out.append(value if tag == LONG else (tag, value))
            continue
        held = bytearray()
        while True:
            b = key[i]
            i += 1
            if b == 0:
                follow = key[i]
                i += 1
                if follow == 0:
                    break
            held.append(b)
        raw = bytes(held)
        out.append(raw.decode() if tag == STRING else raw if tag == RAW_BYTES else (tag, decode(raw)))
    return out


_LATIN = "ISO-8859-1"


def _number(wide: Column, at: Column) -> Column:
    """The 8 bytes from `at` as the number that `_fixed` wrote. Their upper half is below 2**32, so no conversion overflows."""
    half = lambda k: F.conv(F.hex(F.encode(F.substring(wide, at + k, F.lit(4)), _LATIN)), 16, 10).cast("bigint")
    return (half(0) - (1 << 31)) * F.lit(1 << 32) + half(4)


def decode_parts(key: Column, *tags: int) -> list[Column]:
    """The values of an encoded key of known part types, as columns: a bigint, string or binary for each tag."""
    wide, at, out = F.decode(key, _LATIN), F.lit(1), []
    for tag in tags:
        here = at + 1
        if tag in (LONG, TS_ATTRIBUTE):
            out.append(F.when(F.substring(wide, at, F.lit(1)) == chr(tag), _number(wide, here)))
            at = here + 8
            continue
        # No 00 inside a part is followed by another, so the first pair of them ends it.
        end = F.call_function("locate", F.lit(_END), wide, here)
        held = F.encode(F.replace(F.substring(wide, here, end - here), F.lit(_ZERO_ONE), F.lit(_ZERO)), _LATIN)
        good = F.substring(wide, at, F.lit(1)) == chr(tag)
        out.append(F.when(good, F.decode(held, "UTF-8") if tag == STRING else held))
        at = end + 2
    return out


def typed(tag: int, long: Column | None = None, string: Column | None = None, raw: Column | None = None) -> Column:
    """One part as a struct; arrays of such structs compare as keys do."""
    pick = lambda c, kind: (c if c is not None else F.lit(None)).cast(kind)
    return F.struct(F.lit(tag).cast("tinyint").alias("tag"), pick(long, "bigint").alias("l"), pick(string, "string").alias("s"), pick(raw, "binary").alias("b"))


def parse(path: Column) -> Column:
    """The parts of a '/'-separated key. A trailing '/' is an error; null stays null."""
    bad = F.raise_error(F.concat(F.lit("key ends with its delimiter: "), path))
    return F.when(path.endswith("/"), bad.cast("array<string>")).otherwise(F.split(path, "/", -1))


def append_part(parts: Column, part: Column) -> Column:
    return F.array_append(parts, part)


def insert_part(parts: Column, part: Column) -> Column:
    return F.array_prepend(parts, part)


def is_subkey_of(parts: Column, parent: Column) -> Column:
    """Whether the key begins with the parent's parts; an equal key does."""
    return F.slice(parts, 1, F.size(parent)) == parent
