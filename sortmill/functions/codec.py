"""Scalar codecs: sortable decimals, escaped bytes, CRC-16. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lsd(number: Column, digits: int) -> Column:
    """Zero-padded decimal of `digits` places, which sorts as the number does; longer or negative numbers are errors."""
    text = number.cast("string")
    bad = F.raise_error(F.concat(F.lit(f"no decimal of {digits} places: "), text)).cast("string")
    return F.when((F.length(text) > digits) | (number < 0), bad).otherwise(F.lpad(text, digits, "0"))


def from_lsd(text: Column) -> Column:
    bad = F.raise_error(F.concat(F.lit("not a decimal: "), text)).cast("bigint")
    return F.when(text.rlike("^[0-9]+$"), text.cast("bigint")).otherwise(F.when(text.isNotNull(), bad))


def byte_values(raw: Column) -> Column:
    """The bytes of a binary as an array of integers; empty for an empty one."""
    digits = F.hex(raw)
    none = F.array().cast("array<int>")
    at = F.when(F.length(raw) > 0, F.sequence(F.lit(0), F.length(raw) - 1)).otherwise(none)
    return F.when(raw.isNotNull(), F.transform(at, lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int")))


def crc16_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ 0xA001 if i & 1 else i >> 1
        out.append(i)
    return out


def crc16(raw: Column) -> Column:
    """CRC-16 of reflected polynomial 0xA001 from 0; null of null."""
    steps = F.array(*map(F.lit, crc16_table()))
    step = lambda crc, b: F.shiftright(crc, 8).bitwiseXOR(F.element_at(steps, crc.bitwiseXOR(b).bitwiseAND(F.lit(255)) + 1))
    return F.aggregate(byte_values(raw), F.lit(0), step)


def escape(raw: Column, listed: bytes, mark: int) -> Column:
    """Each byte of `listed` as `mark` and its place in the list. `mark` must be listed, or decoding would be ambiguous."""
    if mark not in listed:
        raise ValueError("the escape byte must be among the escaped bytes")
    if any(b < len(listed) for b in listed):
        raise ValueError("places in the list must not be listed bytes themselves")
    wide = F.decode(raw, "ISO-8859-1")
    for b in [mark, *[b for b in listed if b != mark]]:  # the mark first, as the others bring new ones
        wide = F.replace(wide, F.lit(chr(b)), F.lit(chr(mark) + chr(listed.index(b))))
    return F.encode(wide, "ISO-8859-1")


def unescape(raw: Column, listed: bytes, mark: int) -> Column:
    wide = F.decode(raw, "ISO-8859-1")
    for i in [i for i, b in enumerate(listed) if b != mark]:
        wide = F.replace(wide, F.lit(chr(mark) + chr(i)), F.lit(chr(listed[i])))
    return F.encode(F.replace(wide, F.lit(chr(mark) + chr(listed.index(mark))), F.lit(chr(mark))), "ISO-8859-1")
