"""The corpus pipeline, stage by stage, against brute force over what the stage before left."""

import base64
import hashlib
import itertools
import math
from collections import Counter

import duckdb
import tiktoken
from test_dedup import brute_lines, jaccard, shingles
from test_selection import poisson

import corpus_pipeline
from sortmill.llm import bpe, minhash, mixing, quality

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def key(r):
    return tuple(str(r[c]) for c in COLUMNS)


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "src0", None), (9002, "", "en", "src0", 0), (None, "of the and that", "en", None, 15), (9004, "$$$ ### " * 4000, "en", "src1", 32000)], docs.schema)
    docs = docs.unionByName(odd)
    out = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, DATA)
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        out.append([r.asDict() for r in docs.collect()])
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == COLUMNS
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "bpe_encode"]
    good, lines, near, mixed, encoded = out

    con = duckdb.connect()
    source = spark.read.parquet(f"{DATA}/documents.parquet").unionByName(odd).toPandas()
    con.register("documents", source.astype({"doc_id": "Int64", "n_chars": "Int64"}))
    want = con.execute(quality.SQL).fetchall()
    assert Counter((r["doc_id"], r["lang"], r["source"]) for r in good) == Counter(want)
    assert not {9001, 9002, 9004} & {r["doc_id"] for r in good} and len(good) >= 0.8 * 200

    assert sorted(((r["doc_id"], r["text"]) for r in lines), key=str) == brute_lines([(r["doc_id"], r["text"]) for r in good])

    named = {r["doc_id"]: shingles(r["text"]) for r in lines if r["doc_id"] is not None}
    root = {d: d for d in named}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(named), 2):
        if jaccard(named[a], named[b]) >= minhash.THRESHOLD:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    gone = {d for d in named if find(d) != d}
    kept = {r["doc_id"] for r in near if r["doc_id"] is not None}
    found = set(named) - kept
    assert found <= gone and len(found) >= 0.9 * len(gone) and gone
    assert sum(r["doc_id"] is None for r in near) == sum(r["doc_id"] is None for r in lines)

    size = Counter()
    for r in near:
        size[r["source"]] += len((r["text"] or "").encode())
    root_sum, total = sum(math.sqrt(v) for v in size.values()), sum(size.values())
    want = Counter()
    for r in near:
        rate = math.sqrt(size[r["source"]]) / root_sum * total / size[r["source"]]
        ident = "null" if r["doc_id"] is None else str(r["doc_id"])
        digest = hashlib.md5((r["text"] or "").encode()).hexdigest()
        u = int(hashlib.md5(f"{mixing.SEED}:{ident}:{digest}".encode()).hexdigest()[:13], 16) / 2**52
        want[key(r)] += poisson(rate, u)
    assert Counter(map(key, mixed)) == +want

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert Counter(map(key, encoded)) == Counter(map(key, mixed))
    for r in encoded:
        assert r["tokens"] == other.encode_ordinary(r["text"]) and r["n_tokens"] == len(r["tokens"]) and r["exact"]


def test_run_and_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = corpus_pipeline.run(spark, DATA)
    assert got.columns == [*COLUMNS, "tokens", "n_tokens", "exact"] and got.count() > 100
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
