"""Quality rules whose limits come from the corpus: outlier fences from quantile sketches per language and source.

Features of a text with N words (runs of characters above U+0020):

- richness: ln(distinct words) / ln(N), 1 for a single word; low where text repeats, steady in length
- symbols: share of its visible characters that are neither letters nor digits
- capitals: share of its letters that are upper case
- width: visible characters per word
- bare: share of its words without a letter or digit

Each feature has a sketch per (lang, source): counts of logarithmic buckets of GAMMA. Sketches merge by adding
counts, exactly and in any order. A (lang, source) of fewer than MIN_GROUP texts takes the merged sketch of its
language, and that of the whole corpus where the language too has fewer. With the quartiles q1, q2, q3 of that sketch and
spread = max(q3 - q1, FLOOR), a text fails if a feature lies beyond q1 - FENCE * spread or q3 + FENCE * spread, on the
sides that SIDES names. A short text says little, so N words count as N of N + PRIOR, and the median as the rest.

Defined cases: texts that are null or have no word are rejected. Null lang or source is a group of its own. A null doc_id
is kept or rejected as any other row. Repeated rows count and are judged one by one. Further columns are carried,
whatever their names.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from sortmill.llm._text import blocks, release
from sortmill.llm._work import fresh, slim_batches, small, written

GAMMA, MIN_GROUP, FENCE, PRIOR, FLOOR = 1.002, 50, 6.0, 20.0, 0.005
#: For each feature, whether low and high values fail.
SIDES = {"richness": (True, False), "symbols": (False, True), "capitals": (False, True), "width": (True, True), "bare": (False, True)}
#: Values up to this share one lowest bucket.
TINY, LOWEST = 1e-6, -1_000_000
BLOCK = 1 << 20


#: What a character is: visible, and if so a letter, digit or capital. Made once in a process.
_VISIBLE, _LETTER, _NUMBER, _UPPER = 1, 2, 4, 8
_classes: list[np.ndarray] = []
_GAPS = bytes.maketrans(bytes(range(33)), b" " * 33)


def classes() -> np.ndarray:
    """The classes of each code point."""
    if not _classes:
        out = np.full(0x110000, _VISIBLE, np.uint8)
        out[:33] = 0
        for c, name in enumerate(map(unicodedata.category, map(chr, range(0x110000)))):
            if name[0] == "L":
                out[c] |= _LETTER | (_UPPER if name == "Lu" else 0)
            elif name[0] == "N":
                out[c] |= _NUMBER
        _classes.append(out)
    return _classes[0]


COUNTS = ("n", "v", "visible", "letters", "solid", "upper", "spoken")


def counts(texts: list[str]) -> np.ndarray:
    """A row of COUNTS for each text: words, distinct words, visible characters, letters, letters and digits, capitals, and words with a letter or digit."""
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    for i, j in blocks(np.concatenate([[0], np.cumsum(sizes)]), BLOCK):
        words = [t.encode().translate(_GAPS).split() for t in texts[i:j]]
        out[i:j, 0] = [len(w) for w in words]
        out[i:j, 1] = [len(set(w)) for w in words]
        kind = classes()[np.frombuffer((" ".join(texts[i:j]) + " ").encode("utf-32-le"), np.uint32)]
        first = np.cumsum(sizes[i:j]) - sizes[i:j]
        solid = kind & (_LETTER | _NUMBER) > 0
        # A word's first letter or digit: no other is between it and the word's start.
        inside = kind > 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        at = np.flatnonzero(solid)
        word = np.cumsum(begins, dtype=np.int32)[at]
        spoken = at[np.flatnonzero(np.diff(word, prepend=0))]
        for k, mask in enumerate((inside, kind & _LETTER > 0, solid, kind & _UPPER > 0), 2):
            out[i:j, k] = np.add.reduceat(mask, first, dtype=np.int64)
        out[i:j, 6] = np.bincount(np.searchsorted(first, spoken, "right") - 1, minlength=j - i)
    return out


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def features(text: pa.Array) -> pa.Array:
    """The counts that the features of SIDES are ratios of, for texts with words."""
    got = counts(text.to_pylist())
    release()
    return pa.StructArray.from_arrays([pa.array(got[:, k].copy()) for k in range(len(COUNTS))], list(COUNTS))


def _ratios(c: str) -> Column:
    n, v, visible = F.col(f"{c}.n").cast("double"), F.col(f"{c}.v").cast("double"), F.col(f"{c}.visible").cast("double")
    letters = F.col(f"{c}.letters").cast("double")
    return F.struct(
        n.alias("n"),
        F.when(n > 1, F.ln(v) / F.ln(n)).otherwise(F.lit(1.0)).alias("richness"),
        ((visible - F.col(f"{c}.solid")) / visible).alias("symbols"),
        F.when(letters > 0, F.col(f"{c}.upper") / letters).otherwise(F.lit(0.0)).alias("capitals"),
        (visible / n).alias("width"),
        ((n - F.col(f"{c}.spoken")) / n).alias("bare"),
    )


def _has_words() -> Column:
    return F.col("text").cast("string").rlike(r"[^\x00-\x20]")


def sketch(docs: DataFrame) -> DataFrame:
    """(lang, source, feature, bucket, count) over all texts that have words."""
    rows = docs.filter(_has_words()).select(F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), features(F.col("text").cast("string")).alias("c"))
    rows = rows.select("lang", "source", _ratios("c").alias("r"))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"r.{f}").alias("value")) for f in SIDES)))
    rows = rows.select("lang", "source", each.alias("e")).select("lang", "source", "e.feature", "e.value")
    bucket = F.when(F.col("value") <= TINY, F.lit(LOWEST)).otherwise(F.ceil(F.ln("value") / F.lit(GAMMA_LN)).cast("int"))
    return rows.groupBy("lang", "source", "feature", bucket.alias("bucket")).agg(F.count("*").alias("count"))


GAMMA_LN = 0.001998002662673058  # ln(1.002), written out so that every engine has the same bits


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, feature, total, q1, q2, q3) of the sketches merged to `keys`."""
    merged = sketches.groupBy(*keys, "feature", "bucket").agg(F.sum("count").alias("count"))
    part = W.partitionBy(*keys, "feature")
    merged = merged.withColumn("upto", F.sum("count").over(part.orderBy("bucket"))).withColumn("total", F.sum("count").over(part))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("total") * q, F.col("bucket")))
    value = lambda b: F.when(F.col(b) == LOWEST, F.lit(0.0)).otherwise(F.exp(F.col(b) * GAMMA_LN) * (2.0 / (1.0 + GAMMA)))
    found = merged.groupBy(*keys, "feature").agg(F.max("total").alias("total"), at(0.25).alias("b1"), at(0.5).alias("b2"), at(0.75).alias("b3"))
    return found.select(*keys, "feature", "total", value("b1").alias("q1"), value("b2").alias("q2"), value("b3").alias("q3"))


def limits(sketches: DataFrame) -> DataFrame:
    """One row for each (lang, source): a struct (low, mid, high) for each feature, from the finest sketch of MIN_GROUP texts."""
    fine = quartiles(sketches, ["lang", "source"]).alias("s")
    mid, all_ = quartiles(sketches, ["lang"]).alias("l"), quartiles(sketches, []).alias("a")
    both = fine.join(mid, F.expr("s.lang <=> l.lang AND s.feature = l.feature"), "left").join(all_, F.expr("s.feature = a.feature"), "left")
    pick = lambda q: F.when(F.col("s.total") >= MIN_GROUP, F.col(f"s.{q}")).when(F.col("l.total") >= MIN_GROUP, F.col(f"l.{q}")).otherwise(F.col(f"a.{q}")).alias(q)
    both = both.select("s.lang", "s.source", "s.feature", pick("q1"), pick("q2"), pick("q3"))
    room = F.greatest(F.col("q3") - F.col("q1"), F.lit(FLOOR)) * FENCE
    both = both.select("lang", "source", "feature", F.struct((F.col("q1") - room).alias("low"), F.col("q2").alias("mid"), (F.col("q3") + room).alias("high")).alias("fence"))
    return both.groupBy("lang", "source").agg(*(F.max(F.when(F.col("feature") == f, F.col("fence"))).alias(f) for f in SIDES))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that no rule rejects, with the columns that they came with."""
    slim_batches(docs.sparkSession)
    fences = written(limits(written(sketch(docs), "quality-sketches")), "quality-limits")
    c, r, f, gl, gs = fresh(docs, "counts", "ratios", "fences", "group_lang", "group_source")
    fences = fences.select(F.col("lang").alias(gl), F.col("source").alias(gs), F.struct(*SIDES).alias(f))
    fences = small(fences, fences.count(), 256)
    rows = docs.filter(_has_words()).withColumn(c, features(F.col("text").cast("string"))).withColumn(r, _ratios(c))
    rows = rows.join(fences, F.col("lang").cast("string").eqNullSafe(F.col(gl)) & F.col("source").cast("string").eqNullSafe(F.col(gs)))
    ok = F.lit(True)
    for name, (low, high) in SIDES.items():
        n, x, fence = F.col(f"{r}.n"), F.col(f"{r}.{name}"), f"{f}.{name}"
        x = (n * x + PRIOR * F.col(f"{fence}.mid")) / (n + PRIOR)
        if low:
            ok &= x >= F.col(f"{fence}.low")
        if high:
            ok &= x <= F.col(f"{fence}.high")
    return rows.filter(ok).select(*[docs[x] for x in docs.columns])


def _sql() -> str:
    quart = """SELECT {keys} feature, max(total) AS total, min(CASE WHEN upto >= total * 0.25 THEN bucket END) AS b1, min(CASE WHEN upto >= total * 0.5 THEN bucket END) AS b2, min(CASE WHEN upto >= total * 0.75 THEN bucket END) AS b3
      FROM (SELECT *, sum(cnt) OVER (PARTITION BY {keys} feature ORDER BY bucket) AS upto, sum(cnt) OVER (PARTITION BY {keys} feature) AS total
            FROM (SELECT {keys} feature, bucket, sum(cnt) AS cnt FROM sk GROUP BY {keys} feature, bucket)) GROUP BY {keys} feature"""
    pick = ", ".join(f"CASE WHEN s.total >= {MIN_GROUP} THEN s.b{i} WHEN l.total >= {MIN_GROUP} THEN l.b{i} ELSE a.b{i} END AS b{i}" for i in (1, 2, 3))
    value = lambda b: f"CASE WHEN {b} = {LOWEST} THEN 0.0::DOUBLE ELSE exp({b} * {GAMMA_LN!r}::DOUBLE) * (2.0::DOUBLE / (1.0::DOUBLE + {GAMMA}::DOUBLE)) END"
    tests = []
    for name, (low, high) in SIDES.items():
        x = f"(n * {name} + {PRIOR}::DOUBLE * max(q2) FILTER (feature = '{name}')) / (n + {PRIOR}::DOUBLE)"
        tests += [f"{x} >= max(low) FILTER (feature = '{name}')"] * low + [f"{x} <= max(high) FILTER (feature = '{name}')"] * high
    return f"""
    WITH words AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, text, list_filter(string_split_regex(text, '[\\x00-\\x20]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
    counts AS (SELECT rid, doc_id, lang, source, len(w)::DOUBLE AS n, len(list_distinct(w))::DOUBLE AS v, length(regexp_replace(text, '[\\x00-\\x20]+', '', 'g'))::DOUBLE AS visible,
      length(regexp_replace(text, '[^\\p{{L}}]+', '', 'g'))::DOUBLE AS letters, length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))::DOUBLE AS solid,
      length(regexp_replace(text, '[^\\p{{Lu}}]+', '', 'g'))::DOUBLE AS upper, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}][^\\x00-\\x20]*'))::DOUBLE AS spoken FROM words WHERE len(w) > 0),
    ratios AS (SELECT rid, doc_id, lang, source, n, CASE WHEN n > 1 THEN ln(v) / ln(n) ELSE 1.0::DOUBLE END AS richness, (visible - solid) / visible AS symbols, CASE WHEN letters > 0 THEN upper / letters ELSE 0.0::DOUBLE END AS capitals, visible / n AS width, (n - spoken) / n AS bare FROM counts),
    long AS ({" UNION ALL ".join(f"SELECT lang, source, '{f}' AS feature, {f} AS value FROM ratios" for f in SIDES)}),
    sk AS (SELECT lang, source, feature, CASE WHEN value <= {TINY}::DOUBLE THEN {LOWEST} ELSE ceil(ln(value) / {GAMMA_LN!r}::DOUBLE)::INT END AS bucket, count(*) AS cnt FROM long GROUP BY 1, 2, 3, 4),
    s AS ({quart.format(keys="lang, source,")}), l AS ({quart.format(keys="lang,")}), a AS ({quart.format(keys="")}),
    picked AS (SELECT s.lang, s.source, s.feature, {pick} FROM s LEFT JOIN l ON s.lang IS NOT DISTINCT FROM l.lang AND s.feature = l.feature LEFT JOIN a ON s.feature = a.feature),
    quarts AS (SELECT lang, source, feature, {value("b1")} AS q1, {value("b2")} AS q2, {value("b3")} AS q3 FROM picked),
    fences AS (SELECT *, q1 - greatest(q3 - q1, {FLOOR}::DOUBLE) * {FENCE}::DOUBLE AS low, q3 + greatest(q3 - q1, {FLOOR}::DOUBLE) * {FENCE}::DOUBLE AS high FROM quarts)
    SELECT r.doc_id, r.lang, r.source FROM ratios r JOIN fences f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source
    GROUP BY rid, r.doc_id, r.lang, r.source, n, richness, symbols, capitals, width, bare HAVING {" AND ".join(tests)}"""


SQL = _sql()
