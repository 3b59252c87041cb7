"""Key templates: pipes that turn a row's context into a hierarchical key, and qualifiers that turn a query into a range.

Parts are written `/=value`. A value that is missing and has no default is an error, raised for the row that lacks it.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = "/="


def context(name: str, default: Any = None) -> Column:
    return F.col(name) if default is None else F.coalesce(F.col(name), F.lit(default))


def _needed(value: Column, what: str) -> Column:
    return F.coalesce(value.cast("string"), F.raise_error(F.lit(f"missing context: {what}")).cast("string"))


class End:
    def key(self) -> Column:
        return F.lit("")


class Partition:
    """Appends one context value, then what the next stage appends."""

    def __init__(self, name: str, then: "Stage | None" = None, default: Any = None) -> None:
        self.name, self.then, self.default = name, then or End(), default

    def key(self) -> Column:
        return F.concat(F.lit(PREFIX), _needed(context(self.name, self.default), self.name), self.then.key())


class Mux:
    """Appends a selector's value and goes on with the pipe for that value; an unmapped value is an error."""

    def __init__(self, selector: Column | str, routes: "Mapping[str, Stage]", default: str | None = None) -> None:
        self.selector = F.col(selector) if isinstance(selector, str) else selector
        self.routes, self.default = routes, default

    def key(self) -> Column:
        chosen = self.selector if self.default is None else F.coalesce(self.selector, F.lit(self.default))
        chosen = _needed(chosen, "selector")
        out = None
        for value, stage in self.routes.items():
            made = F.concat(F.lit(PREFIX + value), stage.key())
            out = F.when(chosen == value, made) if out is None else out.when(chosen == value, made)
        bad = F.raise_error(F.concat(F.lit("no route for selector "), chosen)).cast("string")
        return bad if out is None else out.otherwise(bad)


Stage = End | Partition | Mux


def parts_of(key: Column) -> Column:
    """The values of a key: the way back from key to context."""
    return F.transform(F.filter(F.split(key, "/"), lambda p: p.startswith("=")), lambda p: F.substring(p, 2, 1 << 30))


def context_of(key: Column, names: list[str]) -> Column:
    """The context that a chain of partitions made a key from: a struct of its values by name, null where the key is shorter."""
    values = parts_of(key)
    return F.struct(*[F.try_element_at(values, F.lit(i)).alias(n) for i, n in enumerate(names, 1)])


def exact(c: Column, value: Any) -> Column:
    """Equals `value`, which may not be null."""
    if value is None:
        raise ValueError("an exact qualifier needs a value")
    return F.concat(F.lit("="), c.cast("string")) == F.lit(f"={value}")


def anything(c: Column) -> Column:
    """Any value: the range around the `=` that each part begins with."""
    return F.concat(F.lit("="), c.cast("string")).between("<", ">")


def starts(c: Column, prefix: str) -> Column:
    return c.cast("string").startswith(prefix)


def ranging(c: Column, low: Any = None, high: Any = None) -> Column:
    """Between two values, both included; None leaves an end open."""
    ok = c.isNotNull()
    if low is not None:
        ok = ok & (c >= F.lit(low))
    return ok if high is None else ok & (c <= F.lit(high))


def looked_up(df: DataFrame, name: str, allowed: DataFrame, column: str) -> DataFrame:
    """Rows whose `name` is among the values that another query gives."""
    return df.join(allowed.select(F.col(column).alias(name)).distinct(), name, "left_semi")


def key_bounds(parts: list[Any]) -> tuple[str, str]:
    """The lowest and highest key, both included, that a row qualifier admits: leading values exact, from the first None on any.

    A part is written `/=value`, so any part lies between `/<` and `/>`.
    """
    lead = ""
    for value in parts:
        if value is None:
            return lead + "/<", lead + "/>"
        lead += f"{PREFIX}{value}"
    return lead, lead


def in_row_range(key: Column, parts: list[Any]) -> Column:
    """Whether a key made by a pipe lies in the range of a row qualifier: a range of one column, which reaches the scan."""
    low, high = key_bounds(parts)
    return key.between(low, high)


def excluding(c: Column, value: Any) -> Column:
    return c != F.lit(value)


def containing(c: Column, part: str) -> Column:
    return c.cast("string").contains(part)


def qualify(df: DataFrame, **wanted: Any) -> DataFrame:
    """Rows whose columns have the exact values; None stands for any value."""
    for name, value in wanted.items():
        df = df.filter(anything(F.col(name)) if value is None else exact(F.col(name), value))
    return df
