"""Composition, predicates and maps of event frames.

An operator is a function from DataFrame to DataFrame. ``keys`` name the
columns by which a stream is split; each key then has its own state.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

Op = Callable[[DataFrame], DataFrame]


def column(selector: str | Column | Callable[[], Column]) -> Column:
    """A selector as a column: a column, SQL text, or a function that returns one."""
    return F.expr(selector) if isinstance(selector, str) else selector() if callable(selector) and not isinstance(selector, Column) else selector


def order(keys: Iterable[str], time: str = "time_us", tie: str = "event_id") -> WindowSpec:
    """Events of each key in order of time, ties by id."""
    return Window.partitionBy(*keys).orderBy(time, tie)


def compose(*ops: Op | list[Op]) -> Op:
    """Chain operators left to right; a list counts as its members. None is the identity."""
    flat = [f for op in ops for f in (op if isinstance(op, (list, tuple)) else [op])]
    return lambda df: functools.reduce(lambda d, f: d.transform(f), flat, df)


pipe = compose


def unit(emit: Callable[[DataFrame], DataFrame]) -> Op:
    """A user's operator; stateful ones are built with :mod:`deltaloom.operators.stateful`."""
    return emit


def filter_(df: DataFrame, test: str | Column) -> DataFrame:
    return df.filter(column(test))


def tagged(df: DataFrame, tag: str, tags: str = "tags") -> DataFrame:
    """Events with a tag; those without tags go."""
    return df.filter(F.array_contains(tags, tag))


def taggedany(df: DataFrame, wanted: list[str], tags: str = "tags") -> DataFrame:
    return df.filter(F.arrays_overlap(F.col(tags), F.array(*map(F.lit, wanted))))


def taggedall(df: DataFrame, wanted: list[str], tags: str = "tags") -> DataFrame:
    return df.filter(F.col(tags).isNotNull() & (F.size(F.array_except(F.array(*map(F.lit, wanted)), F.col(tags))) == 0))


def each(df: DataFrame, fn: Callable[[DataFrame], None]) -> DataFrame:
    """Call ``fn`` with the events and pass them on. In a stream, use it within foreachBatch."""
    fn(df)
    return df


def map_(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Set columns of every event."""
    return df.withColumns({k: column(v) for k, v in columns.items()})


def copy(df: DataFrame) -> DataFrame:
    """The same events: a DataFrame does not change."""
    return df


def log(df: DataFrame, channel: str = "log", n: int = 20) -> DataFrame:
    """Print some events under a channel (log, error or trace) and pass all on."""
    print(f"[{channel}]")
    df.show(n, truncate=False)
    return df


def flatten(df: DataFrame, events: str = "events") -> DataFrame:
    """An array of events into one row each; a column that is no array passes."""
    return df.select(F.inline(events)) if df.schema[events].dataType.typeName() == "array" else df


def changed(df: DataFrame, selector: str | Column, keys: Iterable[str] = (), initial=None, has_initial: bool = False, time: str = "time_us", tie: str = "event_id") -> DataFrame:
    """Events whose value is not that of the event before. The first passes, unless it equals ``initial`` where one is given."""
    w, v = order(keys, time, tie), column(selector)
    before = F.lag(v).over(w)
    first = F.row_number().over(w) == 1
    test = F.when(first, ~v.eqNullSafe(F.lit(initial)) if has_initial else F.lit(True)).otherwise(~v.eqNullSafe(before))
    return df.withColumn("__keep", test).filter("__keep").drop("__keep")


def combine(*streams: DataFrame) -> DataFrame:
    """All events of several streams; columns that one lacks are null."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)


def split(df: DataFrame, selector: str | Column, op: Callable[[DataFrame, list[str]], DataFrame], name: str = "split") -> DataFrame:
    """Run an operator on each key's events: ``op(df, keys)``. Keys are text."""
    return op(df.withColumn(name, column(selector).cast("string")), [name])


def every(df: DataFrame, *ops: Op) -> list[DataFrame]:
    """Hand the same events to several operators."""
    return [op(df) for op in ops]
