"""Windows over the events of a key that need no more than window functions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltaloom.operators.stateless import column, order


def contexttime(df: DataFrame, ms: int, keys: Iterable[str], time: str = "time_us", tie: str = "event_id", aggregates: dict[str, Column] | None = None) -> DataFrame:
    """For each event the events before it, at most ``ms`` old, without itself: as array ``events``, or as the aggregates given.

    An aggregate is a column over the range; as it must leave out the event
    itself and those of the same time after it, sums subtract it: use
    :func:`contexttime_sums` for sums and counts without arrays.
    """
    w = Window.partitionBy(*keys).orderBy(time).rangeBetween(-ms * 1000, 0)
    if aggregates:
        return df.withColumns({k: c.over(w) for k, c in aggregates.items()})
    inside = F.collect_list(F.struct(*df.columns)).over(w)
    before = F.filter(inside, lambda x: F.struct(x[time], x[tie]) < F.struct(F.col(time), F.col(tie)))
    return df.withColumn("events", before)


def contexttime_sums(df: DataFrame, selector: str | Column, ms: int, keys: Iterable[str], time: str = "time_us", tie: str = "event_id") -> DataFrame:
    """Count and sum over what :func:`contexttime` gives: the range up to the event's time, less itself and later events of that time."""
    keys, v = list(keys), F.coalesce(column(selector), F.lit(0))
    w = Window.partitionBy(*keys).orderBy(time).rangeBetween(-ms * 1000, 0)
    same = Window.partitionBy(*keys, time).orderBy(tie).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({"context_count": F.count(F.lit(1)).over(w) - F.count(F.lit(1)).over(same), "context_sum": F.sum(v).over(w) - F.sum(v).over(same)})


def contextcount(df: DataFrame, n: int, keys: Iterable[str], time: str = "time_us", tie: str = "event_id", aggregates: dict[str, Column] | None = None) -> DataFrame:
    """For each event the last ``n`` of its key, itself included: as array ``events``, or as the aggregates given."""
    w = order(keys, time, tie).rowsBetween(1 - n, 0)
    return df.withColumns({k: c.over(w) for k, c in (aggregates or {"events": F.collect_list(F.struct(*df.columns))}).items()})


def grouptime(df: DataFrame, ms: int, keys: Iterable[str], aggregates: dict[str, Column] | None = None, time: str = "time_us", tie: str = "event_id") -> DataFrame:
    """Tumbling windows of ``ms`` on the epoch; anchored ones are in :mod:`deltaloom.operators.stateful`."""
    start = (F.floor(F.col(time) / (ms * 1000)) * (ms * 1000)).cast("long").alias("window_us")
    found = aggregates or {"events": F.array_sort(F.collect_list(F.struct(time, tie, *[c for c in df.columns if c not in (time, tie)])))}
    return df.groupBy(*keys, start).agg(*[c.alias(k) for k, c in found.items()])


def groupcount(df: DataFrame, n: int, keys: Iterable[str], aggregates: dict[str, Column] | None = None, time: str = "time_us", tie: str = "event_id") -> DataFrame:
    """Every ``n`` events of a key as one set, ``group_no`` from 0; an incomplete last set is not given out."""
    keys = list(keys)
    numbered = df.withColumn("group_no", F.floor((F.row_number().over(order(keys, time, tie)) - 1) / n).cast("long"))
    found = aggregates or {"events": F.array_sort(F.collect_list(F.struct(time, tie, *[c for c in df.columns if c not in (time, tie)])))}
    out = numbered.groupBy(*keys, "group_no").agg(F.count(F.lit(1)).alias("__n"), *[c.alias(k) for k, c in found.items()])
    return out.filter(F.col("__n") == n).drop("__n")


def samplecount(df: DataFrame, n: int, keys: Iterable[str], time: str = "time_us", tie: str = "event_id") -> DataFrame:
    """Every n-th event of a key."""
    return df.withColumn("__at", F.row_number().over(order(keys, time, tie))).filter(F.col("__at") % n == 0).drop("__at")


def settle(df: DataFrame, ms: int, keys: Iterable[str], time: str = "time_us", tie: str = "event_id") -> DataFrame:
    """Events that no other follows for ``ms``; the last of a key is one."""
    nxt = F.lead(time).over(order(keys, time, tie))
    return df.withColumn("__next", nxt).filter(F.col("__next").isNull() | (F.col("__next") - F.col(time) >= ms * 1000)).drop("__next")


def stable(df: DataFrame, ms: int, selector: str | Column, keys: Iterable[str], time: str = "time_us", tie: str = "event_id") -> DataFrame:
    """Events at most ``ms`` after one of the same value: never the first of a run."""
    w, v = order(keys, time, tie), column(selector)
    calm = (F.col(time) - F.lag(time).over(w) <= ms * 1000) & v.eqNullSafe(F.lag(v).over(w))
    return df.withColumn("__calm", calm).filter("__calm").drop("__calm")


def ddt(df: DataFrame, selector: str | Column, keys: Iterable[str], time: str = "time_us", tie: str = "event_id") -> DataFrame:
    """Change of the value a millisecond since the event before, as ``metric``; 0 for the first and where either does not change."""
    w, v = order(keys, time, tie), column(selector)
    dv, dt = v - F.lag(v).over(w), (F.col(time) - F.lag(time).over(w)) / 1000
    return df.withColumn("metric", F.when((dv != 0) & (dt != 0), dv / dt).otherwise(0.0))


def coalesce_latest(df: DataFrame, keys: Iterable[str], now_us: Column | int, ttl_ms: str | Column = "60000", time: str = "time_us", tie: str = "event_id", state: str | None = None) -> DataFrame:
    """The latest event of each key, with ``state`` "expired" if its time to live ended before ``now_us``. Inbound expired events do not count."""
    keys = list(keys)
    rows = df if state is None else df.filter(F.coalesce(F.col(state), F.lit("")) != "expired")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(time, tie)).alias("e")).select(*keys, "e.*")
    over = F.col(time) + column(ttl_ms).cast("long") * 1000 < (F.lit(now_us) if isinstance(now_us, int) else now_us)
    return last.withColumn(state or "state", F.when(over, F.lit("expired")).otherwise(F.col(state) if state else F.lit(None).cast("string")))


def project(df: DataFrame, predicates: list[str | Column], ttl_ms: str | Column, keys: Iterable[str], time: str = "time_us", tie: str = "event_id") -> DataFrame:
    """For each event, in columns ``slot0``, ``slot1``, ..., the latest event that met each predicate.

    After an event is given out, slots are cleared that have no time to live
    or whose time to live ended before it. As event times only grow within a
    key, a slot is seen iff the event just before the current one lay within
    its time to live, or the slot is the current event's own.
    """
    w = order(keys, time, tie)
    before = F.lag(time).over(w)
    seen = w.rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("__before", before).withColumn("__ttl", column(ttl_ms).cast("long"))
    for k, p in enumerate(predicates):
        out = out.withColumn(f"__s{k}", F.last(F.when(column(p), F.struct(*df.columns, "__ttl")), ignorenulls=True).over(seen))
    slots = {}
    for k in range(len(predicates)):
        s = F.col(f"__s{k}")
        own = s[tie] == F.col(tie)
        alive = s["__ttl"].isNotNull() & (s[time] + s["__ttl"] * 1000 >= F.col("__before"))
        slots[f"slot{k}"] = F.when(own | alive, F.struct(*[s[c].alias(c) for c in df.columns]))
    return out.withColumns(slots).drop("__before", "__ttl", *[f"__s{k}" for k in range(len(predicates))])


def fillin(df: DataFrame, ms: int, keys: Iterable[str], ttl_ms: str | Column = "60000", time: str = "time_us", tie: str = "event_id", generate: dict[str, Column] | None = None) -> DataFrame:
    """All events, and copies every ``ms`` of idle time until the next event or the end of the time to live, with ``filled`` true.

    ``generate`` sets columns of copies; their time is that of the copy.
    """
    nxt = F.lead(time).over(order(keys, time, tie))
    ttl = column(ttl_ms).cast("long") * 1000
    rows = df.withColumn("__next", nxt)
    by_ttl = F.floor(ttl / (ms * 1000))
    by_next = F.when(F.col("__next").isNotNull(), F.ceil((F.col("__next") - F.col(time)) / (ms * 1000)) - 1).otherwise(by_ttl)
    n = F.least(by_ttl, by_next)
    copies = rows.withColumn("__n", n).filter("__n >= 1").withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    copies = copies.withColumn(time, F.col(time) + F.col("__k") * (ms * 1000)).drop("__next", "__n", "__k")
    if generate:
        copies = copies.withColumns(generate)
    return df.withColumn("filled", F.lit(False)).unionByName(copies.withColumn("filled", F.lit(True)))
