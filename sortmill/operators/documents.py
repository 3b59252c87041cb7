"""Document collections: find, update, replace and delete by equality, with secondary indexes as projections.

A query is a mapping of fields to values, all of which must be equal; a null or missing field matches nothing, and an empty
query matches all. Fields may be dotted paths into structs. A collection is immutable: an update returns the new collection.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from sortmill.operators.lsm import write_segments
from sortmill.shared import fresh

Query = Mapping[str, Any]


def matches(query: Query) -> Column:
    """True or false, never null."""
    return reduce(lambda ok, kv: ok & F.coalesce(F.col(kv[0]) == kv[1], F.lit(False)), query.items(), F.lit(True))


def find(docs: DataFrame, query: Query) -> DataFrame:
    """The documents that match, by plain equalities, which reach the scan; a filter takes their nulls as false."""
    return reduce(lambda df, kv: df.filter(F.col(kv[0]) == kv[1]), query.items(), docs)


def index_entries(docs: DataFrame, fields: list[str], pk: str) -> DataFrame:
    """(index_name, part1 .. partn, pk): one entry per document, in the index's key order once written with `write_segments`."""
    parts = [F.col(f).alias(f"part{i}") for i, f in enumerate(fields, 1)]
    return docs.select(F.lit(",".join(fields)).alias("index_name"), *parts, F.col(pk).alias("pk"))


def index_score(query: Query, fields: list[str], primary: bool) -> float:
    """One for each leading field that the query names, up to the first it does not; a tenth more for the primary index."""
    n = 0
    for f in fields:
        if f not in query:
            break
        n += 1
    return n + (0.1 if primary else 0.0)


def rank_indexes(query: Query, indexes: list[list[str]]) -> list[tuple[int, str, float]]:
    """(index number, name, score), the best first; index 0 is the primary one, and ties go to the higher number."""
    scored = [(i, ",".join(f), index_score(query, f, i == 0)) for i, f in enumerate(indexes)]
    return sorted(scored, key=lambda x: (-x[2], -x[0]))


def find_via_index(docs: DataFrame, index: DataFrame, fields: list[str], pk: str, query: Query) -> DataFrame:
    """Documents by way of an index: a filter of its leading parts, a join to the documents, and all fields tested again."""
    entries = index
    for i, f in enumerate(fields, 1):
        if f not in query:
            break
        entries = entries.filter(F.col(f"part{i}") == query[f])
    (own,) = fresh(docs, "own_pk")
    hits = entries.select(F.col("pk").alias(own)).distinct()
    return find(docs.join(hits, F.col(pk) == F.col(own), "left_semi"), query)


def ensure_index(docs: DataFrame, fields: list[str], pk: str, path: str) -> None:
    """Writes the index of `fields` to `path`, in its key order, so that a query of its leading fields reads few row groups."""
    index = index_entries(docs, fields, pk)
    write_segments(index, [*[f"part{i}" for i in range(1, len(fields) + 1)], "pk"], path)


def find_best(docs: DataFrame, query: Query, pk: str, indexes: Mapping[tuple[str, ...], DataFrame]) -> DataFrame:
    """`find` by way of the index that serves the query best; by the documents themselves if none of its leading fields is named.

    `indexes` has the entries of each secondary index by its fields, as `ensure_index` writes them.
    """
    fields = [[pk], *map(list, indexes)]
    best, _, score = rank_indexes(query, fields)[0]
    if best == 0 or score < 1:
        return find(docs, query)
    return find_via_index(docs, indexes[tuple(fields[best])], fields[best], pk, query)


def insert(docs: DataFrame, new: DataFrame, pk: str) -> DataFrame:
    """`docs` with the rows of `new`, which take the place of those of the same key; columns that one side lacks are null there.

    Of rows of `new` that repeat a key one stays; a null key is a key.
    """
    (own,) = fresh(docs, "own_pk")
    keys = new.select(F.col(pk).alias(own)).distinct()
    kept = docs.join(keys, F.col(pk).eqNullSafe(F.col(own)), "left_anti")
    return kept.unionByName(new.dropDuplicates([pk]), allowMissingColumns=True)


def _numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def _assign(docs: DataFrame, path: str, value: Column) -> DataFrame:
    """`docs` with a dotted path set; the parents must be structs."""
    head, _, rest = path.partition(".")
    if not rest:
        return docs.withColumn(head, value)
    return docs.withColumn(head, F.col(head).withField(rest, value))


def _kind(docs: DataFrame, path: str) -> T.DataType | None:
    kind: T.DataType = docs.schema
    for name in path.split("."):
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return None
        kind = kind[name].dataType
    return kind


def apply_update(docs: DataFrame, spec: Mapping[str, Any], match: Column, limit_pk: str | None = None) -> DataFrame:
    """`docs` with `spec` applied to the rows that match.

    A spec holds plain fields and nested mappings, which replace and merge, and operators: $set (the field name is literal), $inc
    (adds; sets where the field is absent, null or no number), $unset (null), and on arrays $push, $pushAll, $addToSet, $pop (1: the
    last, -1: the first), $pull, $pullAll; $rename moves a field. Any other $ name is a ValueError, as is an increment that is no number.
    """
    (mark,) = fresh(docs, "hit")
    out = docs.withColumn(mark, match)
    hit = F.col(mark)

    def put(df: DataFrame, path: str, new: Column, literal: bool = False) -> DataFrame:
        known = path in df.columns if literal else _kind(df, path) is not None
        old = F.col(f"`{path}`" if literal else path) if known else F.lit(None)
        chosen = F.when(hit, new).otherwise(old)
        return df.withColumn(path, chosen) if literal else _assign(df, path, chosen)

    def plain(df: DataFrame, prefix: str, fields: Mapping[str, Any]) -> DataFrame:
        for name, value in fields.items():
            path = f"{prefix}{name}"
            if isinstance(value, Mapping):
                if _kind(df, path) is None:
                    df = _assign(df, path, F.when(hit, F.struct(*[F.lit(v).alias(k) for k, v in value.items()])))
                else:
                    df = plain(df, path + ".", value)
            else:
                df = put(df, path, F.lit(value))
        return df

    for op, fields in spec.items():
        if not op.startswith("$"):
            out = plain(out, "", {op: fields})
            continue
        for path, value in fields.items():
            if op == "$set":
                out = put(out, path, F.lit(value), literal=True)
            elif op == "$inc":
                if isinstance(value, bool) or not isinstance(value, (int, float)):
                    raise ValueError(f"$inc of {path} by {value!r}")
                kind = _kind(out, path)
                new = F.coalesce(F.col(path) + F.lit(value), F.lit(value)) if kind is not None and _numeric(kind) else F.lit(value)
                if kind is not None and not _numeric(kind):
                    new = new.cast(kind)
                out = put(out, path, new)
            elif op == "$unset":
                if _kind(out, path) is not None:
                    out = put(out, path, F.lit(None).cast(_kind(out, path)))
            elif op == "$rename":
                if _kind(out, path) is not None:
                    kind = _kind(out, path)
                    out = out.withColumn(value, F.when(hit, F.col(path)).otherwise(F.col(value) if value in out.columns else F.lit(None).cast(kind)))
                    out = put(out, path, F.lit(None).cast(kind))
            elif op in _ARRAYS:
                out = put(out, path, _ARRAYS[op](F.col(path), value))
            else:
                raise ValueError(f"unknown operator {op}")
    return out.drop(mark)


def _pop(c: Column, end: int) -> Column:
    short = F.greatest(F.size(c) - 1, F.lit(0))
    return F.slice(c, 2 if end < 0 else 1, short)


_ARRAYS = {
    "$push": lambda c, v: F.array_append(F.coalesce(c, F.array()), F.lit(v)),
    "$pushAll": lambda c, v: F.concat(F.coalesce(c, F.array()), F.array(*map(F.lit, v))),
    "$addToSet": lambda c, v: F.when(F.array_contains(c, v), c).otherwise(F.array_append(F.coalesce(c, F.array()), F.lit(v))),
    "$pop": _pop,
    "$pull": lambda c, v: F.array_remove(c, v),
    "$pullAll": lambda c, v: F.filter(c, lambda x: ~F.coalesce(x.isin(v), F.lit(False))),
}


def first_matches(docs: DataFrame, query: Query, pk: str, limit: int) -> DataFrame:
    """The primary keys of the first `limit` matches in key order, exactly `limit` of them if there are as many."""
    return find(docs, query).select(pk).orderBy(pk).limit(limit)


def update(docs: DataFrame, query: Query, spec: Mapping[str, Any], pk: str, limit: int | None = None) -> DataFrame:
    if limit is None:
        return apply_update(docs, spec, matches(query))
    (chosen,) = fresh(docs, "chosen")
    keys = first_matches(docs, query, pk, limit).select(F.col(pk).alias(chosen))
    marked = docs.join(keys, F.col(pk) == F.col(chosen), "left")
    return apply_update(marked, spec, F.col(chosen).isNotNull()).drop(chosen)


def upsert(docs: DataFrame, query: Query, spec: Mapping[str, Any], pk: str) -> DataFrame:
    """`update`, and where nothing matches one new document of the query's fields with the spec applied."""
    types = docs.schema
    blank = docs.sparkSession.range(1).select(*[F.lit(query.get(f.name)).cast(f.dataType).alias(f.name) for f in types])
    (n,) = fresh(docs, "n")
    none = find(docs, query).limit(1).agg(F.count("*").alias(n)).filter(F.col(n) == 0)  # one row or none
    new = apply_update(blank, spec, F.lit(True)).crossJoin(F.broadcast(none)).drop(n)
    return update(docs, query, spec, pk).unionByName(new)


def replace(docs: DataFrame, query: Query, document: Mapping[str, Any], pk: str) -> DataFrame:
    """Matches with all fields but the key taken from `document`, null where it has none."""
    hit = matches(query)
    return docs.select(*[F.col(f.name) if f.name == pk else F.when(hit, F.lit(document.get(f.name)).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) for f in docs.schema])


def delete(docs: DataFrame, query: Query, pk: str | None = None, limit: int | None = None) -> DataFrame:
    if limit is None:
        return docs.filter(~matches(query))
    (gone,) = fresh(docs, "gone")
    keys = first_matches(docs, query, pk, limit).select(F.col(pk).alias(gone))
    return docs.join(keys, F.col(pk) == F.col(gone), "left_anti")


def delete_per_group(docs: DataFrame, query: Query, pk: str, limit: int, groups: list[str]) -> DataFrame:
    """As `delete` with a limit for each group, in one pass."""
    hit, place = fresh(docs, "hit", "nth")
    nth = F.row_number().over(W.partitionBy(*groups, F.col(hit)).orderBy(pk))
    marked = docs.withColumn(hit, matches(query)).withColumn(place, nth)
    return marked.filter(~(F.col(hit) & (F.col(place) <= limit))).drop(hit, place)
