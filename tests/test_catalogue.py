"""Every query with SQL gives what DuckDB gives, on the driver's tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from sortmill.plans.catalogue import PLANNED, QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    out = []
    for r in frame.itertuples(index=False):
        out.append(tuple(None if x is None or x != x else round(float(x), 6) if isinstance(x, float) else str(x) for x in r))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_and_names(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert set(QUERIES) <= set(entry_module.queries())


def test_planner_query(spark):
    """Against the same walk over the listed segments, by plain scans."""
    data = "/root/testdata/sf0.01"
    got = QUERIES["merge_candidates"](spark, data).collect()
    held = {}
    for (e,) in duckdb.sql(f"SELECT event_id FROM '{data}/events.parquet'").fetchall():
        held.setdefault((e % 3, e // (PLANNED * (1 + e % 3))), []).append(e)
    segments = [(g, min(v), max(v)) for (g, _), v in held.items()]
    want = []
    for gen, lo, hi in segments:
        n, first = 1, lo
        for below in range(gen - 1, -1, -1):
            met = sorted((a, b) for g, a, b in segments if g == below and a <= hi and b >= lo)
            if n + len(met) > 10:
                break
            if met and n + len(met) >= 4:
                want.append((round(len(met) / n - 0.02 * gen - 0.003 * (n + len(met)) - 0.03 * (gen - below), 9), n, len(met), f"{met[-1][1]:019d}"))
            if met:
                n, lo, hi = n + len(met), min(lo, met[0][0]), max(hi, met[-1][1])
    assert sorted((r.score, r.n_src, r.n_tgt, r.last_key) for r in got) == sorted(want) and want
    assert [r.score for r in got] == sorted(r.score for r in got)
