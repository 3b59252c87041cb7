"""Mixing sources to target weights by Poisson replication.

Every source s has a weight w; its documents are repeated, at mean, rate = w * (bytes of the corpus) * EPOCHS /
(bytes of s) times, so that its expected share of the output's bytes is w. A document's count inverts the Poisson
distribution of that mean at a uniform number that a hash of (SEED, doc_id, text's digest) gives: the least k whose
cumulative probability exceeds it. Each document is then exploded into its copies, and all copies are placed by a hash of
(SEED, document, copy): first over the partitions, then inside each.

Without weights, a source weighs its bytes to the power ALPHA, over the sum of those, which lifts small sources.

Defined cases: null source is a source; a source that the weights do not name weighs 0, and its documents go; weights are
scaled to sum to 1. Null and empty texts have no bytes, but are drawn like others; a source with no bytes at all keeps
each of its rows at rate EPOCHS. Null doc_id hashes like a value of its own. Repeated rows draw alike, and each is repeated by
its count. Empty tables give empty tables. Further columns are carried, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortmill.llm._work import fresh, small, written

SEED, EPOCHS, ALPHA = 20, 1.0, 0.5


def _digest(*parts: Column) -> Column:
    """The first 52 bits of an MD5, as an integer."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("bigint")


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = EPOCHS) -> DataFrame:
    """(source, rate): the mean repetition rate of each source that `docs` has."""
    sized = docs.select(F.col("source").cast("string").alias("source"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("bigint").alias("bytes"))
    sized = written(sized.groupBy("source").agg(F.sum("bytes").alias("bytes")), "mixing-sizes")
    if weights is None:
        weight = F.pow(F.col("bytes").cast("double"), F.lit(ALPHA))
    else:
        weight = F.lit(0.0)
        for source, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(float(w))).otherwise(weight)
    sized = sized.withColumn("weight", weight)
    whole = sized.agg(F.sum("bytes").alias("all_bytes"), F.sum(F.when(F.col("bytes") > 0, F.col("weight"))).alias("all_weight"))
    rate = F.when(F.col("bytes") > 0, F.col("weight") / F.col("all_weight") * F.col("all_bytes") * epochs / F.col("bytes")).when(F.col("weight") >= 0, F.lit(float(epochs)))
    if weights is not None:
        rate = F.when(F.col("weight") == 0, F.lit(0.0)).otherwise(rate)
    return sized.crossJoin(F.broadcast(whole)).select("source", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def terms(rate: float) -> int:
    """How many counts can have a probability that a 52-bit uniform number could meet: those to 12 deviations above the mean, and 40."""
    return math.ceil(rate + 12.0 * math.sqrt(rate) + 40.0)


def cumulative(rate: float) -> np.ndarray:
    """P(X <= 0), P(X <= 1), ... of a Poisson variable, as running sums of exp(k ln(rate) - rate - ln k!)."""
    n = terms(rate)
    if rate <= 0:
        return np.ones(n)
    k = np.arange(n, dtype=np.float64)
    factorial = np.fromiter(map(math.lgamma, range(1, n + 1)), np.float64, n)
    return np.cumsum(np.exp(k * math.log(rate) - rate - factorial))


def _with_steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"source": batch["source"], "upto": [cumulative(r) for r in batch["rate"]]})


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = EPOCHS, seed: int = SEED, copy: str | None = None) -> DataFrame:
    """The copies of `docs`, in the columns of `docs` and, if named, one with the number of the copy from 0."""
    src, steps, count, nth, where, own, u = fresh(docs, "mix_source", "mix_steps", "mix_count", "mix_nth", "mix_where", "mix_digest", "mix_uniform")
    # A row for each source; the sums are as long as its rate asks for, and a source of high rate has few documents.
    of = written(rates(docs, weights, epochs).mapInPandas(_with_steps, "source string, upto array<double>"), "mixing-steps")
    of = of.select(F.col("source").alias(src), F.col("upto").alias(steps))
    size = of.agg(F.sum(F.size(steps) * F.lit(8) + 64)).first()[0] or 0
    of = small(of, 1, size)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.withColumn(own, F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    # Made below the join: a lambda's free expressions are evaluated for each element.
    rows = rows.withColumn(u, _digest(F.lit(str(seed)), name, F.col(own)) / F.lit(float(1 << 52)))
    rows = rows.join(of, F.col("source").cast("string").eqNullSafe(F.col(src)))
    # The count is the number of cumulative sums that do not exceed the uniform number.
    drawn = F.size(F.filter(F.col(steps), lambda p: p <= F.col(u)))
    rows = rows.withColumn(count, drawn).filter(F.col(count) > 0)
    rows = rows.select(*[docs[c] for c in docs.columns], own, F.explode(F.sequence(F.lit(0), F.col(count) - 1)).alias(nth))
    rows = rows.withColumn(where, F.xxhash64(F.lit(seed), "doc_id", own, nth)).drop(own)
    rows = rows.repartition(where).sortWithinPartitions(where)
    return rows.select(*[F.col(c) for c in docs.columns], *([F.col(nth).alias(copy)] if copy else []))


def _sql() -> str:
    return f"""
    WITH sized AS (SELECT source, sum(coalesce(strlen(text), 0))::DOUBLE AS bytes FROM documents GROUP BY source),
    whole AS (SELECT sum(bytes) AS all_bytes, sum(pow(bytes, {ALPHA}::DOUBLE)) FILTER (bytes > 0) AS all_weight FROM sized),
    rates AS (SELECT source, CASE WHEN bytes > 0 THEN pow(bytes, {ALPHA}::DOUBLE) / all_weight * all_bytes * {EPOCHS}::DOUBLE / bytes ELSE {EPOCHS}::DOUBLE END AS rate FROM sized, whole),
    counts AS (SELECT source, rate, unnest(range(ceil(rate + 12.0::DOUBLE * sqrt(rate) + 40.0::DOUBLE)::BIGINT)) AS k FROM rates),
    terms AS (SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1.0::DOUBLE)) AS p FROM counts),
    upto AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
    drawn AS (SELECT row_number() OVER () AS rid, doc_id, text, lang, source, n_chars, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT / {float(1 << 52)}::DOUBLE AS u FROM documents),
    counted AS (SELECT rid, count(*) FILTER (c <= u) AS times FROM drawn d JOIN upto s ON d.source IS NOT DISTINCT FROM s.source GROUP BY rid)
    SELECT doc_id, text, lang, source, n_chars, unnest(range(times))::INT AS copy FROM drawn JOIN counted USING (rid) WHERE times > 0"""


SQL = _sql()
