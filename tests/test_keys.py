"""Typed hierarchical keys: byte order is key order, prefixes are ranges."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sortmill.functions import codec
from sortmill.operators import keys


def encoded(spark, made):
    out = []
    for parts in made:
        cols = [keys.long_part(F.lit(p)) if isinstance(p, int) else keys.bytes_part(F.lit(p)) if isinstance(p, bytes) else keys.string_part(F.lit(p)) for p in parts]
        out.append(keys.encode(*cols))
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(out)]).first()
    return [bytes(x) for x in row]


def rank(part):
    return (1, part) if isinstance(part, int) else (2, part.encode()) if isinstance(part, str) else (11, part)


def test_order_and_round_trip(spark):
    rng = random.Random(3)
    atoms = [12131, -5, 0, 2**63 - 1, -(2**63), "12131", "test2", "test2a", "", "a\x00b", "a", "é", b"\x00\x02\x03\x04\x05", b"\x00\x02\x03", b"\xff", b""]
    made = [[rng.choice(atoms) for _ in range(rng.randrange(1, 4))] for _ in range(60)] + [["1"], ["1!"], ["1", "2"]]
    got = encoded(spark, made)
    assert [keys.decode(b) for b in got] == made
    for (a, x), (b, y) in itertools.combinations(zip(made, got), 2):
        left, right = [rank(p) for p in a], [rank(p) for p in b]
        assert (x < y) == (left < right) and (x == y) == (left == right)


def test_long_before_string_and_prefix_before_rest(spark):
    a, b, c, d, e = encoded(spark, [[12131], ["12131"], ["test", "test2", "blah"], ["test", "test2a", "blah"], ["test", "test3", "blah"]])
    assert a < b and c < d < e


def test_prefix_range(spark):
    made = [[".zdata", "index", "you", "doc1", "word1"], [".zdata", "index", "your", "doc1"], [".zdata", "index", "you"], [".zdata", "index"]]
    whole = encoded(spark, made)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(whole)], "i int, k binary")
    prefix = keys.encode(*[keys.string_part(F.lit(p)) for p in (".zdata", "index", "you")])
    assert {r.i for r in df.filter(keys.in_prefix(F.col("k"), prefix)).collect()} == {0, 2}


def test_nested_and_version_parts(spark):
    inner = keys.encode(keys.string_part(F.lit("a")), keys.long_part(F.lit(7)))
    key = keys.encode(keys.nested_part(inner), keys.version_part(F.lit(9)))
    assert keys.decode(bytes(spark.range(1).select(key.alias("k")).first().k)) == [(keys.RECORD_KEY, ["a", 7]), (keys.TS_ATTRIBUTE, 9)]


def test_struct_arrays_compare_alike(spark):
    df = spark.range(1).select(
        (F.array(keys.typed(keys.LONG, long=F.lit(12131))) < F.array(keys.typed(keys.STRING, string=F.lit("12131")))).alias("a"),
        (F.array(keys.typed(keys.STRING, string=F.lit("1"))) < F.array(keys.typed(keys.STRING, string=F.lit("1")), keys.typed(keys.STRING, string=F.lit("2")))).alias("b"),
    )
    assert tuple(df.first()) == (True, True)


def test_parsed_keys(spark):
    df = spark.createDataFrame([("a/b/c",), (None,)], "p string")
    assert [r.k for r in df.select(keys.parse(F.col("p")).alias("k")).collect()] == [["a", "b", "c"], None]
    with pytest.raises(Exception, match="delimiter"):
        spark.createDataFrame([("a/b/",)], "p string").select(keys.parse(F.col("p"))).collect()
    sub = spark.range(1).select(*[keys.is_subkey_of(F.array(*map(F.lit, k)), F.array(F.lit("a"), F.lit("b"))).alias(str(i)) for i, k in enumerate((["a", "b"], ["a", "b", "c"], ["a"], ["a", "bc"]))]).first()
    assert tuple(sub) == (True, True, False, False)
    parts = F.array(F.lit("b"))
    assert spark.range(1).select(keys.insert_part(keys.append_part(parts, F.lit("c")), F.lit("a")).alias("k")).first().k == ["a", "b", "c"]


def crc(data):
    c = 0
    for b in data:
        c ^= b
        for _ in range(8):
            c = c >> 1 ^ 0xA001 if c & 1 else c >> 1
    return c


def test_codecs(spark):
    rng = random.Random(4)
    raws = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 2, 17, 300)] + [b"123456789", b"\x80\x81\x82\x80", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, b binary")
    marks = bytes([0x80, 0x81, 0x82])
    escaped = codec.escape(F.col("b"), marks, 0x80)
    for r in df.select("i", codec.crc16(F.col("b")).alias("c"), escaped.alias("e"), codec.unescape(escaped, marks, 0x80).alias("u")).collect():
        raw = raws[r.i]
        if raw is None:
            assert r.c is None and r.e is None
            continue
        assert r.c == crc(raw) and bytes(r.u) == raw
        assert bytes(r.e) == b"".join(bytes([0x80, marks.index(b)]) if b in marks else bytes([b]) for b in raw)
    assert crc(b"123456789") == 0xBB3D
    assert tuple(spark.range(1).select(codec.lsd(F.lit(42), 5), codec.from_lsd(F.lit("00042"))).first()) == ("00042", 42)
    for bad in (codec.lsd(F.lit(123456), 5), codec.from_lsd(F.lit("4x"))):
        with pytest.raises(Exception, match="decimal"):
            spark.range(1).select(bad).collect()


def test_decoding_in_columns(spark):
    rng = random.Random(4)
    texts = ["", "a", "a\x00b", "\x00", "\x00\x00\x01", "é漢", "end\x00"]
    numbers = [0, 1, -1, 2**63 - 1, -(2**63), 1 << 32, -(1 << 31), 12131]
    rows = [(i, rng.choice(texts), rng.choice(numbers), rng.choice(numbers), bytes(rng.choice(b"\x00\x01\xff") for _ in range(rng.randrange(5)))) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, s string, l bigint, v bigint, b binary")
    key = keys.encode(keys.long_part(F.col("l")), keys.string_part(F.col("s")), keys.bytes_part(F.col("b")), keys.version_part(F.col("v")))
    got = df.select("i", key.alias("key"))
    parts = keys.decode_parts(F.col("key"), keys.LONG, keys.STRING, keys.RAW_BYTES, keys.TS_ATTRIBUTE)
    back = {r[0]: (r[2], r[1], r[4], bytes(r[3])) for r in got.select("i", *parts).collect()}
    assert back == {i: (s, l, v, b) for i, s, l, v, b in rows}
    wrong = keys.decode_parts(F.col("key"), keys.STRING)
    assert got.select(wrong[0]).first()[0] is None  # a part of another type is null
