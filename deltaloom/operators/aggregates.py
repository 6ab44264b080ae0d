"""Aggregates over sets of events. The sets are the groups of ``keys``.

All are hash aggregates with partial sums before the shuffle, but for
percentiles and reduce, which need a key's events in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltaloom.operators.stateless import column


def _event(df: DataFrame) -> Column:
    return F.struct(*df.columns)


def _last(df: DataFrame, time: str, tie: str) -> Column:
    return F.max_by(_event(df), F.struct(time, tie))


def _grouped(df: DataFrame, keys: Iterable[str], event: Column, **more: Column) -> DataFrame:
    """One event a group, with more columns that replace its own."""
    out = df.groupBy(*keys).agg(event.alias("__e"), *[c.alias(f"__{k}") for k, c in more.items()]).filter("__e is not null")
    return out.select(*[F.col(f"__e.{c}").alias(c) for c in df.columns if c not in more], *[F.col(f"__{k}").alias(k) for k in more])


def max_(df: DataFrame, selector: str | Column, keys: Iterable[str] = (), time: str = "time_us", tie: str = "event_id") -> DataFrame:
    """The event of the largest value in each group, the earliest of several. Null values lose."""
    v = column(selector)
    return _grouped(df, keys, F.max_by(_event(df), F.when(v.isNotNull(), F.struct(v.alias("v"), (-F.col(time)).alias("t"), (-F.col(tie)).alias("i")))))


def min_(df: DataFrame, selector: str | Column, keys: Iterable[str] = (), time: str = "time_us", tie: str = "event_id") -> DataFrame:
    """The event of the smallest value in each group, the earliest of several. Null values lose."""
    v = column(selector)
    return _grouped(df, keys, F.min_by(_event(df), F.when(v.isNotNull(), F.struct(v.alias("v"), time, tie))))


def sum_(df: DataFrame, selector: str | Column, keys: Iterable[str] = (), time: str = "time_us", tie: str = "event_id") -> DataFrame:
    """The last event of each group with the sum as ``metric``."""
    return _grouped(df, keys, _last(df, time, tie), metric=F.sum(column(selector)))


def count_(df: DataFrame, keys: Iterable[str] = (), time: str = "time_us", tie: str = "event_id") -> DataFrame:
    """The last event of each group with the number of events as ``metric``."""
    return _grouped(df, keys, _last(df, time, tie), metric=F.count(F.lit(1)))


def stats(df: DataFrame, selector: str | Column, keys: Iterable[str] = (), time: str = "time_us", tie: str = "event_id", now: Column | None = None) -> DataFrame:
    """The last event of each group with count, sum, average, min and max; its time is ``now`` where given, else stays."""
    v = column(selector)
    more = {"count": F.count(F.lit(1)), "sum": F.sum(v), "average": F.sum(v) / F.count(F.lit(1)), "min": F.min(v), "max": F.max(v)}
    out = _grouped(df, keys, _last(df, time, tie), **more)
    return out if now is None else out.withColumn(time, now)


def rate(df: DataFrame, selector: str | Column, ms: float, keys: Iterable[str] = (), time: str = "time_us", tie: str = "event_id") -> DataFrame:
    """The last event of each group with the sum a millisecond of ``ms`` as ``metric``."""
    return _grouped(df, keys, _last(df, time, tie), metric=F.sum(column(selector)) / F.lit(float(ms)))


def reduce_(df: DataFrame, fn: Callable[[Column, Column], Column], keys: Iterable[str] = (), time: str = "time_us", tie: str = "event_id", value: str | Column | None = None, name: str = "result") -> DataFrame:
    """Fold each group's events in order by ``fn(current, event)``; the first is the seed and is folded as well.

    ``value`` limits what is gathered and folded to an expression; default: the event.
    Null values are skipped and an empty group gives nothing. The group is
    gathered in an array: use it on groups of bounded size, such as windows.
    """
    v = _event(df) if value is None else column(value)
    rows = F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct(F.col(time), F.col(tie), v.alias("v")))))
    out = df.groupBy(*keys).agg(rows.alias("__rows")).filter(F.size("__rows") > 0)
    return out.select(*keys, F.aggregate("__rows", F.col("__rows")[0]["v"], lambda acc, x: fn(acc, x["v"])).alias(name))


def percentiles(df: DataFrame, selector: str | Column, points: list[float], keys: Iterable[str] = (), time: str = "time_us", tie: str = "event_id", name: str | None = None) -> DataFrame:
    """For each point p the event at place min(floor(p n), n - 1) of each group in order of value, with ``point``; ``name`` gets the point appended.

    Sorts within a key; the few places wanted are matched by position.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("__v", column(selector)).withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__at", F.row_number().over(w.orderBy("__v", time, tie)) - 1)
    at = [F.least(F.floor(F.lit(float(p)) * F.col("__n")), F.col("__n") - 1) for p in points]
    matched = F.filter(F.array(*[F.when(a == F.col("__at"), F.lit(float(p))) for p, a in zip(points, at, strict=True)]), lambda x: x.isNotNull())
    out = ranked.withColumn("point", F.explode(matched)).drop("__v", "__n", "__at")
    return out if name is None else out.withColumn(name, F.concat_ws(" ", F.col(name), F.format_string("%s", F.col("point"))))


def apdex(df: DataFrame, satisfied: str | Column, tolerated: str | Column, ms: int, keys: Iterable[str] = (), time: str = "time_us", state: str | None = None) -> DataFrame:
    """Counts of satisfied, else tolerated events and their apdex for each window of ``ms`` on the epoch. Expired events do not count."""
    good, fair = F.coalesce(column(satisfied), F.lit(False)), F.coalesce(column(tolerated), F.lit(False))
    rows = df if state is None else df.filter(F.coalesce(F.col(state), F.lit("")) != "expired")
    start = (F.floor(F.col(time) / (ms * 1000)) * (ms * 1000)).cast("long").alias("window_us")
    out = rows.groupBy(*keys, start).agg(F.sum(good.cast("long")).alias("satisfied"), F.sum((~good & fair).cast("long")).alias("tolerated"), F.count(F.lit(1)).alias("__n"))
    return out.withColumn("apdex", (F.col("satisfied") + F.col("tolerated") / 2) / F.col("__n")).drop("__n")


def group_sums(df: DataFrame, path: list[str], selector: str | Column, sign: str | Column = "1", name: str = "value") -> DataFrame:
    """Sums by one or more keys, of values with a sign: 1 for what was added, -1 for what was taken."""
    return df.groupBy(*path).agg(F.sum(column(selector) * column(sign)).alias(name))


def objstats(df: DataFrame, value: str = "value") -> DataFrame:
    """min, max, sum and avg over the rows of a keyed measure."""
    return df.agg(F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("sum"), F.avg(value).alias("avg"))


def byvaluedesc(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("value").desc(), "key")


def byvalueasc(df: DataFrame) -> DataFrame:
    return df.orderBy("value", "key")


def bykeydesc(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("key").desc())


def bykeyasc(df: DataFrame) -> DataFrame:
    return df.orderBy("key")


def zip_measures(measures: dict[str, DataFrame], least: float = 0.1) -> DataFrame:
    """Merge keyed measures (``key``, ``value``) on their keys; values nearer to 0 than ``least`` drop out, and count as 0 where others remain.

    A union and one aggregate, whatever the number of measures.
    """
    rows = None
    for name, df in measures.items():
        part = df.filter(F.abs("value") >= least).select("key", F.lit(name).alias("__m"), F.col("value").cast("double").alias("value"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("key").agg(*[F.coalesce(F.max(F.when(F.col("__m") == name, F.col("value"))), F.lit(0.0)).alias(name) for name in measures])


def counters(df: DataFrame, visible: str | Column) -> DataFrame:
    """``selected`` and ``total`` rows."""
    return df.agg(F.count_if(column(visible)).alias("selected"), F.count(F.lit(1)).alias("total"))
