"""Mixing, quality rules and sharding: SQL on the driver's tables, brute force and odd rows on small ones."""

import hashlib
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sortmill.llm import mixing, quality, registry, sharding

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
DATA = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    whole = lambda x: str(int(x)) if isinstance(x, float) and x == int(x) else str(x)
    return sorted([tuple(None if pd.isna(x) else whole(x) for x in r) for r in frame.itertuples(index=False)], key=str)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    assert rows(registry.QUERIES[name](spark, DATA).toPandas()) == rows(con.execute(registry.SQL[name]).df())


def odd(spark):
    made = [(1, None, None, None, None), (None, "one two three", "en", "a", 13), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (3, "word " * 50_000, "en", "b", 250_000), (3, "again the same id", "en", "b", 17), (4, "\n \t", "fr", None, 3)]
    return spark.createDataFrame(made, SCHEMA)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_odd_rows_agree_with_sql(spark, name, tmp_path):
    df = odd(spark).unionByName(spark.read.parquet(f"{DATA}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 10))
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert rows(registry.QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(con.execute(registry.SQL[name]).df())


def poisson(rate, u):
    k, c = 0, 0.0
    while True:
        c += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate > 0 else float(k == 0)
        if c > u or k > 400:
            return k
        k += 1


def test_counts_invert_the_distribution(spark):
    docs = spark.createDataFrame([(i, f"text {i:06d}", "en", "big" if i % 5 else "small", 11) for i in range(4000)], SCHEMA)
    weights = {"big": 3.0, "small": 1.0, "absent": 2.0}
    mixed = mixing.mix(docs, weights, epochs=2.0, copy="nth").collect()
    share = {"big": 3.0, "small": 1.0}
    total, times = 4000 * 11, Counter(r.doc_id for r in mixed)
    for i in range(4000):
        s = "big" if i % 5 else "small"
        rate = share[s] / 4.0 * total * 2.0 / ((3200 if i % 5 else 800) * 11)
        digest = hashlib.md5(f"text {i:06d}".encode()).hexdigest()
        u = int(hashlib.md5(f"{mixing.SEED}:{i}:{digest}".encode()).hexdigest()[:13], 16) / 2**52
        assert times[i] == poisson(rate, u)
    assert {(r.doc_id, r.nth) for r in mixed} == {(i, n) for i, c in times.items() for n in range(c)}
    got = Counter(r.source for r in mixed)
    assert abs(got["big"] / len(mixed) - 0.75) < 0.02 and abs(len(mixed) - 8000) < 400


def test_high_rates_and_order(spark):
    docs = spark.createDataFrame([(i, "abc", "en", "rare" if i < 20 else "rest", 3) for i in range(2000)], SCHEMA)
    mixed = mixing.mix(docs, {"rare": 1.0, "rest": 1.0}).collect()
    got = Counter(r.source for r in mixed)
    assert abs(got["rare"] - 1000) < 150 and abs(got["rest"] - 1000) < 150
    ids = [r.doc_id for r in mixed]
    assert ids != sorted(ids) and sum(a == b for a, b in zip(ids, ids[1:])) < len(ids) / 10
    again = mixing.mix(docs.repartition(5), {"rare": 1.0, "rest": 1.0}).collect()
    assert sorted(r.doc_id for r in again) == sorted(ids)  # the counts do not depend on how the rows came
    assert [r.doc_id for r in mixing.mix(docs, {"rare": 1.0, "rest": 1.0}).collect()] == ids  # the same rows come in the same order


def test_mixing_odd_cases(spark):
    assert mixing.mix(odd(spark).limit(0)).count() == 0
    df = odd(spark).withColumns({"rate": F.lit("x"), "mix_count": F.lit(2), "base": F.lit(3), "upto": F.lit(1)})
    got = mixing.mix(df)
    assert got.columns == df.columns and {r.rate for r in got.collect()} <= {"x"}
    assert {r.source for r in mixing.mix(odd(spark), {None: 1.0, "a": 0.0}).collect()} <= {None}
    same = mixing.mix(spark.createDataFrame([(1, "t", "en", "a", 1)] * 50, SCHEMA), epochs=3.0).count()
    assert same % 50 == 0  # equal rows draw alike


def test_quality_rules(spark):
    rng = random.Random(21)
    words = [f"{a}{b}{c}" for a in ("lo", "mi", "ra", "te", "su") for b in ("ne", "do", "ka", "pi") for c in ("", "s", "n", "r", "lt")]
    good = [" ".join(rng.choice(words) for _ in range(rng.randrange(40, 400))).capitalize() + "." for _ in range(300)]
    bad = ["$$$ ### !!! @@@ " * 60, "BUY NOW CHEAP " * 80, "spam " * 400, "x" * 5000, "1 2 3 4 5 6 7 8 9 0 " * 50]
    df = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(good + bad)], SCHEMA)
    kept = {r.doc_id for r in quality.keep_good(df).collect()}
    assert len(kept & set(range(300))) >= 297 and not kept & set(range(300, 305))


def test_sketches_merge_and_bound_quantiles(spark):
    rng = random.Random(22)
    df = spark.createDataFrame([(i, "ab " * rng.randrange(1, 9) + "q" * rng.randrange(1, 60), "en", "s", 0) for i in range(500)], SCHEMA)
    one = quality.sketch(df)
    two = quality.sketch(df.filter("doc_id < 200")).unionByName(quality.sketch(df.filter("doc_id >= 200")))
    a = {(r.feature): (r.total, r.q1, r.q2, r.q3) for r in quality.quartiles(one, []).collect()}
    assert a == {(r.feature): (r.total, r.q1, r.q2, r.q3) for r in quality.quartiles(two, []).collect()}
    widths = sorted((len(r.text.replace(" ", "")) / len(r.text.split())) for r in df.collect())
    for q, got in zip((0.25, 0.5, 0.75), a["width"][1:]):
        assert abs(got / widths[math.ceil(q * 500) - 1] - 1) < 0.005


def test_quality_odd_cases(spark):
    assert quality.keep_good(odd(spark).limit(0)).count() == 0
    df = odd(spark).withColumns({"counts": F.lit(1), "fences": F.lit(2), "bucket": F.lit(3), "richness": F.lit(4)})
    got = quality.keep_good(df)
    assert got.columns == df.columns and all(r.text and r.text.strip() for r in got.collect())


def brute_place(sizes, shards, room):
    cap = [max(1.0, float(c)) / shards * (1 + room) if c else 1.0 / shards * (1 + room) for c in sizes.sum(axis=0)]
    left = [[1.0] * sizes.shape[1] for _ in range(shards)]
    out = []
    for row in sizes:
        need = [v / c for v, c in zip(row, cap)]
        best = None
        for s in range(shards):
            if all(x >= n - 1e-12 for x, n in zip(left[s], need)):
                dot = round(sum(x * n for x, n in zip(left[s], need)), 12)
                if best is None or dot > best[0]:
                    best = (dot, s)
        if best is None:
            best = min((round(max(n - x for x, n in zip(left[s], need)), 12), s) for s in range(shards))
        out.append(best[1])
        left[best[1]] = [x - n for x, n in zip(left[best[1]], need)]
    return out


def test_placement_by_dot_product():
    rng = np.random.default_rng(23)
    for shards in (1, 3, 7):
        sizes = rng.integers(1, 1000, (60, 3)).astype(float)
        sizes = sizes[np.argsort(-(sizes / sizes.sum(axis=0)).max(axis=1), kind="stable")]
        assert sharding.place(sizes, shards).tolist() == brute_place(sizes, shards, sharding.ROOM)


def test_buckets_cells_and_shards_against_brute_force(spark):
    rng = random.Random(25)
    made = [(None if i % 50 == 0 else i % 900, "word, " * rng.randrange(0, 60), "en", None if i % 11 == 0 else f"s{min(5, int(rng.expovariate(0.7)))}", 0) for i in range(1000)]
    df = spark.createDataFrame(made, SCHEMA)
    size, cell_shards = 9_000, 4
    got = Counter((r.doc_id, r.source, r.n_bytes, r.n_tokens, r.shard) for r in sharding.assign_shards(df, size, cell_shards).collect())
    rows = df.select("doc_id", "source", F.octet_length("text").alias("b"), sharding.token_estimate(F.col("text")).alias("t"), F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")).alias("spread"), F.xxhash64("source").alias("hs")).collect()
    whole = [sum(r.b for r in rows), sum(r.t for r in rows), len(rows)]
    shards = -(-whole[0] // size)
    cells = -(-shards // cell_shards)
    assert shards > 8 and cells > 2
    of = {}
    for r in rows:
        of.setdefault(r.source, []).append((r.b, r.t, 1))
    buckets = {s: max(1, math.ceil(max(sum(v[k] for v in vs) / whole[k] for k in range(3)) * shards * sharding.PIECES)) for s, vs in of.items()}
    groups, member = {}, []
    for r in rows:
        bucket = r.spread % buckets[r.source]
        turn = (bucket + r.hs) % shards
        cell = ((turn + 1) * cells - 1) // shards
        key = (cell, r.source, bucket)
        groups.setdefault(key, np.zeros(3))
        groups[key] += (r.b, r.t, 1)
        member.append(key)
    hashed = spark.createDataFrame([(s, b) for _, s, b in groups], "source string, bucket bigint").select("source", "bucket", F.xxhash64("source", "bucket").alias("grp")).collect()
    grp = {(r.source, r.bucket): r.grp for r in hashed}
    shard = {}
    for c in range(cells):
        mine = [k for k in groups if k[0] == c]
        total = np.maximum(sum(groups[k] for k in mine), 1)
        mine.sort(key=lambda k: (-round(max(groups[k] / total), 12), grp[k[1:]]))
        first, last = c * shards // cells, (c + 1) * shards // cells
        for k, at in zip(mine, brute_place(np.array([groups[k] for k in mine]), last - first, sharding.ROOM)):
            shard[k] = first + at
    assert got == Counter((r.doc_id, r.source, r.b, r.t, shard[k]) for r, k in zip(rows, member))


def test_shards_balance_all_dimensions(spark):
    rng = random.Random(24)
    made = [(i, ("12 . , " if i % 3 else "wordwordword ") * rng.randrange(1, 120), "en", f"s{min(9, int(rng.expovariate(0.5)))}", 0) for i in range(4000)]
    got = sharding.assign_shards(spark.createDataFrame(made, SCHEMA), shard_bytes=100_000, cell_shards=4).toPandas()
    assert len(got) == 4000 and sorted(got.doc_id) == list(range(4000))
    totals = got.assign(n=1).groupby("shard")[["n_bytes", "n_tokens", "n"]].sum()
    assert len(totals) == -(-got.n_bytes.sum() // 100_000)
    assert ((totals / totals.mean() - 1).abs() < 0.25).all().all()


def test_sharding_odd_cases(spark):
    assert sharding.assign_shards(odd(spark).limit(0)).count() == 0
    df = odd(spark).withColumns({"grp": F.lit(1), "shard": F.lit(2), "bucket": F.lit(3), "cell": F.lit(4)})
    got = sharding.assign_shards(df, shard_bytes=10_000).collect()
    assert len(got) == 7 and all(r.shard is not None for r in got)
    assert len({r.shard for r in got if r.doc_id == 3}) == 1 and len({r.shard for r in got if r.doc_id == 2}) == 1
    assert max(r.n_bytes for r in got) == 250_000
