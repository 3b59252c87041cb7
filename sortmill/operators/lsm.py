"""Update logs in generations: newest update wins, deletions are tombstones, compaction merges generations.

`newest_wins` is one aggregate with map-side combining, so that one row for each key and task is shuffled, however many updates a
hot key has. (Its buffers are structs, so Spark sorts by key where it would else hash; the sorts spill.) Key ranges may be
filtered before it; tombstones and values only after it, or deleted rows would come back.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sortmill.operators.order import ranked, with_previous
from sortmill.shared import fresh

TOMBSTONE, PARTIAL, FULL, NONE = "DELETION_TOMBSTONE", "PARTIAL", "FULL", "NONE"
TYPE = "update_type"


def newest_wins(updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The update of each key that is greatest in `order`, which must not tie within a key. Null keys are a key."""
    rest = [c for c in updates.columns if c not in keys]
    (best,) = fresh(updates, "best")
    newest = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias(best))
    return newest.select(*keys, *[F.col(f"{best}.{c}").alias(c) for c in rest])


def applicable(updates: DataFrame) -> DataFrame:
    """Updates without NONE, which do nothing; PARTIAL has no defined merge and is an error."""
    kind = F.when(F.col(TYPE) == PARTIAL, F.raise_error(F.lit("PARTIAL updates cannot be merged")).cast("string")).otherwise(F.col(TYPE))
    return updates.withColumn(TYPE, kind).filter(F.col(TYPE) != NONE)


def visible(newest: DataFrame) -> DataFrame:
    return newest.filter(F.col(TYPE) != TOMBSTONE)


def merge_read(updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """What a reader sees: each key's newest update, deleted keys hidden."""
    return visible(newest_wins(applicable(updates), keys, order))


def compact(updates: DataFrame, keys: list[str], order: list[str], gen: str = "gen") -> DataFrame:
    """The update log merged into its lowest generation, `target_gen`.

    Tombstones stay, as they hide what deeper generations hold; there is nothing beneath generation 0, so there they go.
    """
    low = updates.agg(F.coalesce(F.min(gen), F.lit(0)).alias("target_gen"))
    merged = newest_wins(applicable(updates), keys, order).crossJoin(F.broadcast(low))
    return merged.filter((F.col("target_gen") > 0) | (F.col(TYPE) != TOMBSTONE))


def merge_sorted(one: DataFrame, two: DataFrame, keys: list[str], left_wins: bool = False, source: str = "src", pos: str | None = "pos", forward: bool = True) -> DataFrame:
    """Both inputs' rows with the name of their source and their place in the common order of `keys`, of equal keys the left row first.

    Where the left wins, one row per key, the left one's if it has one. `pos` None leaves the place out, and with it the sort.
    """
    both = one.withColumn(source, F.lit("one")).unionByName(two.withColumn(source, F.lit("two")))
    if left_wins:
        rest = [c for c in both.columns if c not in keys and c != source]
        (best,) = fresh(both, "best")
        first = both.groupBy(*keys).agg(F.min_by(F.struct(source, *rest), source).alias(best))
        both = first.select(*keys, *[F.col(f"{best}.{c}").alias(c) for c in [*rest, source]])
    if pos is None:
        return both
    return ranked(both, *[F.col(k).asc() if forward else F.col(k).desc() for k in keys], F.col(source).asc(), pos=pos)


def intersect_sorted(one: DataFrame, two: DataFrame, key: str | Column, v1: str, v2: str, other: Column | None = None) -> DataFrame:
    """(k, v1, v2) for keys on both sides, whose keys are unique; a key may be an expression, and another one on the right."""
    left = F.col(key) if isinstance(key, str) else key
    return one.select(left.alias("k"), F.col(v1).alias("v1")).join(two.select((left if other is None else other).alias("k"), F.col(v2).alias("v2")), "k")


def check_ascending(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """(dup_adjacent, non_ascending): how often a key equals, or is below, that of the row before."""
    df = df.select(*dict.fromkeys([*by, key]))
    (prev,) = fresh(df, "previous")
    rows = with_previous(df, [F.col(c) for c in by], key, prev)
    return rows.agg(F.count(F.when(F.col(prev) == F.col(key), 1)).alias("dup_adjacent"), F.count(F.when(F.col(prev) > F.col(key), 1)).alias("non_ascending"))


def segment_index(df: DataFrame, key: str, size: int) -> DataFrame:
    """(seg, start_key, end_key, key_count): segments of `size` keys in key order, seg being the place of their first."""
    (pos,) = fresh(df.select(key), "pos")
    rows = ranked(df.select(key), F.col(key), pos=pos)
    seg = (F.col(pos) - 1 - F.pmod(F.col(pos) - 1, F.lit(size))).cast("bigint")
    return rows.groupBy(seg.alias("seg")).agg(F.min(key).alias("start_key"), F.max(key).alias("end_key"), F.count("*").alias("key_count"))


def write_segments(df: DataFrame, keys: list[str], path: str, compression: str = "zstd", rows_per_file: int = 0) -> None:
    """A generation as files of disjoint key ranges, sorted inside, so that statistics prune range scans."""
    by = [F.col(k) for k in keys]
    writer = df.repartitionByRange(*by).sortWithinPartitions(*by).write.option("compression", compression)
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).parquet(path)


def _bounds(df: DataFrame, lo: str, cells: int) -> list:
    """At most `cells` - 1 values that part the starts of `df` about evenly; they decide how work is spread, not what comes out."""
    starts = df.filter(F.col(lo).isNotNull()).select(lo)
    drawn = sorted(r[0] for r in starts.orderBy(F.xxhash64(lo)).limit(cells * 16).collect())
    return list(dict.fromkeys(drawn[len(drawn) * i // cells] for i in range(1, cells))) if drawn else []


def overlap_join(a: DataFrame, b: DataFrame, lo: str, hi: str, cells: int = 128) -> DataFrame:
    """Rows of `a` and `b` whose closed ranges [lo, hi] overlap; columns of `b` get the prefix t_. Ends may be of any ordered type.

    The key space is parted at starts of `b` into at most `cells` cells; each range is listed under those that it touches, so under
    `cells` at most, and a pair meets once: in the first cell that both touch. A null end overlaps nothing.
    """
    right = b.select(*[F.col(c).alias(f"t_{c}") for c in b.columns])
    bounds = _bounds(b, lo, cells)
    kind = b.schema[lo].dataType
    parted = F.array(*[F.lit(x).cast(kind) for x in bounds]) if bounds else F.array().cast(T.ArrayType(kind))
    cell = lambda c: F.size(F.filter(parted, lambda x: x <= F.col(c)))
    name, first, t_first = fresh(a.join(right.limit(0)), "cell", "first_cell", "t_first_cell")

    def spread(df: DataFrame, low: str, high: str, start: str) -> DataFrame:
        held = df.filter(F.col(low) <= F.col(high)).withColumn(start, cell(low))
        return held.withColumn(name, F.explode(F.sequence(F.col(start), cell(high))))

    met = spread(a, lo, hi, first).join(spread(right, f"t_{lo}", f"t_{hi}", t_first), name)
    once = F.col(name) == F.greatest(first, t_first)
    return met.filter(once & (F.col(lo) <= F.col(f"t_{hi}")) & (F.col(hi) >= F.col(f"t_{lo}"))).drop(name, first, t_first)


def segment_overlap(segments: DataFrame) -> DataFrame:
    """(src_gen, src_slot, tgt_gen, tgt_slot): segments over those of lower generations whose key ranges they touch."""
    met = overlap_join(segments, segments, "lo", "hi").filter("gen > t_gen")
    return met.select(F.col("gen").alias("src_gen"), F.col("slot").alias("src_slot"), F.col("t_gen").alias("tgt_gen"), F.col("t_slot").alias("tgt_slot"))


def min_safe_generation(ranges: DataFrame, pid: str, segments: DataFrame) -> DataFrame:
    """(pid, safe_gen): one above the highest generation that a key range touches, 0 where it touches none."""
    top = overlap_join(ranges, segments, "lo", "hi").groupBy(pid).agg((F.max("t_gen") + 1).alias("safe_gen"))
    return ranges.select(pid).distinct().join(top, pid, "left").select(pid, F.coalesce("safe_gen", F.lit(0)).alias("safe_gen"))


def relevant_segments(segments: DataFrame, gen: int, lo: Any, hi: Any, most: int) -> DataFrame | None:
    """The segments of a generation that a key range touches; None if there are more than `most`."""
    met = segments.filter((F.col("gen") == gen) & (F.col("lo") <= hi) & (F.col("hi") >= lo))
    return None if met.limit(most + 1).count() > most else met


def compare_segments(listed: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, state): the segments on which two lists differ: unlisted, missing, or times if one names them more often."""
    (one, two) = fresh(listed, "listed_n", "found_n")
    a = listed.groupBy(*keys).agg(F.count("*").alias(one))
    b = found.groupBy(*[F.col(k).alias(f"t_{k}") for k in keys]).agg(F.count("*").alias(two))
    same = [F.col(k).eqNullSafe(F.col(f"t_{k}")) for k in keys]
    state = F.when(F.col(one).isNull(), "unlisted").when(F.col(two).isNull(), "missing").otherwise("times")
    both = a.join(b, same, "full").filter(~F.col(one).eqNullSafe(F.col(two)))
    return both.select(*[F.coalesce(k, f"t_{k}").alias(k) for k in keys], state.alias("state"))


def verify_segments(listed: DataFrame, found: DataFrame, keys: list[str]) -> None:
    """ValueError where the two lists differ, naming a few of the differences."""
    wrong = compare_segments(listed, found, keys).limit(5).collect()
    if wrong:
        raise ValueError("segment lists differ: " + "; ".join(str(r.asDict()) for r in wrong))


def wants_flush(log_free_share: Column, memtable_bytes: Column) -> Column:
    """Whether a working segment should be written: the log is under 30 % free, or it holds more than 15 blocks of 512 KB."""
    return (log_free_share < 0.3) | (memtable_bytes > 15 * 512 * 1024)


def candidate_score(n_src: Column, n_tgt: Column, hi_gen: Column, lo_gen: Column, pointers: Column | None = None, max_gen: Column | None = None) -> Column:
    """How good a merge is, lower being better: few targets per source, many segments, high and many generations."""
    span, n = hi_gen - lo_gen, n_src + n_tgt
    score = n_tgt.cast("double") / n_src - F.lit(0.02) * hi_gen - F.lit(0.003) * n - F.lit(0.03) * span
    if pointers is None:
        return score
    return score - F.when(pointers & (max_gen - hi_gen > 2), F.lit(0.03) * span + F.lit(0.02) * n).otherwise(F.lit(0.0))


def worth_merging(score: Column, max_gen: Column) -> Column:
    return score <= F.lit(1.6) + max_gen / F.lit(12.0)


@dataclass(frozen=True, order=True)
class Segment:
    gen: int
    lo: str
    hi: str


@dataclass(frozen=True, order=True)
class Candidate:
    score: float
    n_src: int
    n_tgt: int
    sources: tuple[Segment, ...] = field(default=())
    targets: tuple[Segment, ...] = field(default=())


def merge_candidates(segments: Iterable[Segment], smallest: int = 4, largest: int = 10) -> list[Candidate]:
    """Merges worth considering, best first: a segment with all that it touches in the generations beneath, step by step.

    Works on the segment list, which is metadata, not on rows: each generation's segments are disjoint and sorted, so what a range
    touches is found by bisection.
    """
    from bisect import bisect_left, bisect_right

    levels: dict[int, list[Segment]] = {}
    for s in sorted(set(segments)):
        levels.setdefault(s.gen, []).append(s)
    ends = {g: [s.hi for s in row] for g, row in levels.items()}
    starts = {g: [s.lo for s in row] for g, row in levels.items()}
    out = []
    for top in (s for row in levels.values() for s in row):
        sources, lo, hi = [top], top.lo, top.hi
        for gen in range(top.gen - 1, -1, -1):
            row = levels.get(gen, [])
            found = row[bisect_left(ends.get(gen, []), lo) : bisect_right(starts.get(gen, []), hi)]
            if len(sources) + len(found) > largest:
                break
            if not found:
                continue
            if len(sources) + len(found) >= smallest:
                high, n = max(s.gen for s in sources), len(sources) + len(found)
                score = len(found) / len(sources) - 0.02 * high - 0.003 * n - 0.03 * (high - gen)
                out.append(Candidate(round(score, 9), len(sources), len(found), tuple(sources), tuple(found)))
            lo, hi = min(lo, found[0].lo), max(hi, found[-1].hi)
            sources = sources + found
    return sorted(out)
