"""Operators whose next step depends on what they gave out before.

Each is a small machine with ``push(t, e)``, ``fire(d)`` and a ``due`` time;
times are in microseconds. A timer due at d fires before any event with time
d or later, and timers that are left fire at the end of the input. The same
machines run here over sorted partitions and, in
:mod:`deltaloom.streaming.twins`, on streams.

A partition is streamed in order of key and time, so memory holds one
machine, not a key's events. A key is sequential by nature; without keys all
events are, and one task has them.
"""

from __future__ import annotations

import itertools
import math
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from deltaloom.operators.stateless import column

Out = list[tuple[int, Any]]


class Machine:
    """Outputs are (time, event or list of events). ``settings`` names what is given by the caller and never changes: it is no part of the state."""

    due: int | None = None
    settings: tuple[str, ...] = ()

    def state(self) -> dict[str, Any]:
        """What later events depend on; with the same settings, :meth:`resume` goes on from it."""
        return {k: v for k, v in vars(self).items() if k not in self.settings}

    def resume(self, state: dict[str, Any]) -> Machine:
        vars(self).update(state)
        return self

    def push(self, t: int, e: Any) -> Out:
        raise NotImplementedError

    def fire(self, d: int) -> Out:
        return []


class SampleTime(Machine):
    """The first event sets the clock; later ones pass if more than ``us`` after the last that did."""

    def __init__(self, us: int) -> None:
        self.us, self.last = us, None

    def push(self, t, e):
        if self.last is not None and t - self.last <= self.us:
            return []
        first, self.last = self.last is None, t
        return [] if first else [(t, e)]


class Debounce(Machine):
    """Leading events pass at once; within ``us`` of the last output only the newest is held, until then."""

    def __init__(self, us: int) -> None:
        self.us, self.last, self.held = us, None, None

    def push(self, t, e):
        self.due = None
        if self.last is None or t - self.last > self.us:
            self.last = t
            return [(t, e)]
        self.held, self.due = e, self.last + self.us
        return []

    def fire(self, d):
        self.due, self.last, e, self.held = None, d, self.held, None
        return [(d, e)]


class Throttle(Machine):
    """At most ``n`` events in any ``us``; what overflows closes the gate until the oldest is ``us`` old."""

    def __init__(self, n: int, us: int) -> None:
        self.n, self.us, self.recent = n, us, deque()

    def push(self, t, e):
        if self.due is not None:
            return []
        self.recent.append(t)
        while t - self.recent[0] >= self.us:
            self.recent.popleft()
        if len(self.recent) <= self.n:
            return [(t, e)]
        self.due = self.us + self.recent[0]
        return []

    def fire(self, d):
        self.due, self.recent = None, deque()
        return []


class Rollup(Machine):
    """As a throttle that gives events out singly in lists, and those after the gate closed as one list when it opens."""

    def __init__(self, n: int, us: int) -> None:
        self.n, self.us, self.recent, self.rest = n, us, deque(), []

    def push(self, t, e):
        if self.due is not None:
            self.rest.append(e)
            return []
        self.recent.append(t)
        while t - self.recent[0] >= self.us:
            self.recent.popleft()
        if len(self.recent) <= self.n:
            return [(t, [e])]
        self.rest, self.due = [e], self.us + self.recent[0]
        return []

    def fire(self, d):
        self.due, self.recent, rest, self.rest = None, deque(), self.rest, []
        return [(d, rest)]


class Batch(Machine):
    """Lists of ``n`` events, or of what came in ``us`` since the timer started; ``n`` None: by time only."""

    def __init__(self, n: int | None, us: int) -> None:
        self.n, self.us, self.events = n, us, []

    def push(self, t, e):
        if self.due is None:
            self.events, self.due = [e], t + self.us
        else:
            self.events.append(e)
        return self.fire(t) if len(self.events) == self.n else []

    def fire(self, d):
        if not self.events:
            self.due = None
            return []
        out, self.events, self.due = self.events, [], d + self.us
        return [(d, out)]


class Average(Machine):
    """Averages: one value out for each in. An event's value stands in ``__v``; null values give null and change nothing."""

    def value(self, t: int, v: float) -> float:
        raise NotImplementedError

    def push(self, t, e):
        return [(t, e | {"metric": None if e["__v"] is None else self.value(t, e["__v"])})]


class EwmaTimeless(Average):
    """``v r + current (1 - r)``, seeded by the value, and again whenever it is 0."""

    def __init__(self, r: float) -> None:
        self.r, self.current = r, None

    def value(self, t, v):
        self.current = v * self.r + (self.current or v) * (1 - self.r)
        return self.current


class Ewma(Average):
    """Weight exp(-dt / h) for the past, dt since the event before."""

    def __init__(self, us: float) -> None:
        self.us, self.current, self.last = us, None, None

    def value(self, t, v):
        if self.last is None:
            self.current, self.last = v, t
        r = math.exp(-((t - self.last) / self.us))
        self.current, self.last = (1 - r) * v + r * self.current, t
        return self.current


def fold(df: DataFrame, make: Callable[[], Machine], keys: Iterable[str], schema: T.StructType, rows: Callable[[dict, int, int, Any], dict], time: str = "time_us", tie: str = "event_id") -> DataFrame:
    """Run one machine for each key over its events in order; ``rows(key, number, time, output)`` makes a row of each output."""
    keys, names = list(keys), df.columns
    dealt = df.repartition(*keys) if keys else df.coalesce(1)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, key, n, out = None, None, 0, []

        def emit(found: Out) -> None:
            nonlocal n
            for t, x in found:
                out.append(rows(key, n, t, x))
                n += 1

        def finish() -> None:
            while machine is not None and machine.due is not None:
                emit(machine.fire(machine.due))

        for b in batches:
            for e in b.to_pylist():
                own = {k: e[k] for k in keys}
                if machine is None or own != key:
                    finish()
                    machine, key, n = make(), own, 0
                t = e[time]
                while machine.due is not None and machine.due <= t:
                    emit(machine.fire(machine.due))
                emit(machine.push(t, e))
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        finish()
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return dealt.sortWithinPartitions(*keys, time, tie).select(*names).mapInArrow(run, schema)


def _events(df: DataFrame, make: Callable[[], Machine], keys, time: str, tie: str) -> DataFrame:
    """For machines that give out events: the events, with ``fired_us``. Such machines do not look into an event, so it is handed over as the row's values."""
    keys, names = list(keys), [c for c in df.columns if c != "fired_us"]
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField("fired_us", T.LongType())])
    arrow, places, clock = to_arrow_schema(schema), [names.index(k) for k in keys], names.index(time)
    dealt = df.repartition(*keys) if keys else df.coalesce(1)

    def batch_of(out: list) -> pa.RecordBatch:
        columns = zip(*((*e, t) for t, e in out), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, key, out = None, None, []
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            own = zip(*(columns[i] for i in places), strict=True) if places else itertools.repeat(())
            for k, t, e in zip(own, columns[clock], zip(*columns, strict=True), strict=False):
                if machine is None or k != key:
                    while machine is not None and machine.due is not None:
                        out += machine.fire(machine.due)
                    machine, key = make(), k
                while machine.due is not None and machine.due <= t:
                    out += machine.fire(machine.due)
                out += machine.push(t, e)
            if out:
                yield batch_of(out)
                out = []
        while machine is not None and machine.due is not None:
            out += machine.fire(machine.due)
        if out:
            yield batch_of(out)

    return dealt.select(*[f"`{c}`" for c in names]).sortWithinPartitions(*keys, time, tie).mapInArrow(run, schema)


def _lists(df: DataFrame, make: Callable[[], Machine], keys, time: str, tie: str) -> DataFrame:
    """For machines that give out lists: keys, ``group_no``, ``fired_us`` and ``events``."""
    keys = list(keys)
    each = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("group_no", T.LongType()), T.StructField("fired_us", T.LongType()), T.StructField("events", T.ArrayType(each))])
    return fold(df, make, keys, schema, lambda key, n, t, x: key | {"group_no": n, "fired_us": t, "events": x}, time, tie)


def _metric(df: DataFrame, make: Callable[[], Average], selector, keys, time: str, tie: str) -> DataFrame:
    """For averages: every event with its ``metric``, made column by column."""
    keys, names = list(keys), [c for c in df.columns if c != "metric"]
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField("metric", T.DoubleType())])
    places, clock = [names.index(k) for k in keys], names.index(time)
    valued = df.select(*[f"`{c}`" for c in names], column(selector).cast("double").alias("__v"))
    dealt = valued.repartition(*keys) if keys else valued.coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, key = None, None
        for b in batches:
            own = zip(*(b.column(i).to_pylist() for i in places), strict=True) if places else itertools.repeat(())
            out = []
            for k, t, v in zip(own, b.column(clock).to_pylist(), b.column(len(names)).to_pylist(), strict=False):
                if machine is None or k != key:
                    machine, key = make(), k
                out.append(None if v is None else machine.value(t, v))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.float64())], names=schema.names)

    return dealt.sortWithinPartitions(*keys, time, tie).mapInArrow(run, schema)


def sampletime(df: DataFrame, ms: int, keys: Iterable[str], time: str = "time_us", tie: str = "event_id") -> DataFrame:
    """At most one event in each ``ms``; the first only starts the clock."""
    return _events(df, lambda: SampleTime(ms * 1000), keys, time, tie).drop("fired_us")


def debounce(df: DataFrame, ms: int, keys: Iterable[str], time: str = "time_us", tie: str = "event_id") -> DataFrame:
    """Events at least ``ms`` apart, with the time ``fired_us`` when each was given out."""
    return _events(df, lambda: Debounce(ms * 1000), keys, time, tie)


def throttle(df: DataFrame, n: int, ms: int, keys: Iterable[str], time: str = "time_us", tie: str = "event_id") -> DataFrame:
    """At most ``n`` events every ``ms``."""
    return _events(df, lambda: Throttle(n, ms * 1000), keys, time, tie).drop("fired_us")


def rollup(df: DataFrame, n: int, ms: int, keys: Iterable[str], time: str = "time_us", tie: str = "event_id") -> DataFrame:
    """The first ``n`` events in ``ms`` as lists of one, the rest as one list when ``ms`` are over."""
    return _lists(df, lambda: Rollup(n, ms * 1000), keys, time, tie)


def batch(df: DataFrame, n: int, ms: int, keys: Iterable[str], time: str = "time_us", tie: str = "event_id") -> DataFrame:
    """Lists of ``n`` events or of ``ms``, whichever comes first."""
    return _lists(df, lambda: Batch(n, ms * 1000), keys, time, tie)


def grouptime_anchored(df: DataFrame, ms: int, keys: Iterable[str], time: str = "time_us", tie: str = "event_id") -> DataFrame:
    """Tumbling windows that start with an event, follow each other while they have events, and start anew with the next."""
    return _lists(df, lambda: Batch(None, ms * 1000), keys, time, tie)


def ewmatimeless(df: DataFrame, selector, r: float, keys: Iterable[str], time: str = "time_us", tie: str = "event_id") -> DataFrame:
    """Exponentially weighted average by events, as ``metric``."""
    return _metric(df, lambda: EwmaTimeless(r), selector, keys, time, tie)


def ewma(df: DataFrame, selector, h_ms: float, keys: Iterable[str], time: str = "time_us", tie: str = "event_id") -> DataFrame:
    """Exponentially weighted average by time, as ``metric``."""
    return _metric(df, lambda: Ewma(h_ms * 1000), selector, keys, time, tie)


def coalesce(df: DataFrame, selector, ms: int, keys: Iterable[str], ttl_ms: int = 60_000, time: str = "time_us", tie: str = "event_id") -> DataFrame:
    """Every ``ms`` the latest event for each value of a column, as lists; one past its time to live (its ``ttl`` in ms, else ``ttl_ms``) comes once more, with ``state`` "expired"."""
    from deltaloom.streaming.machines import Coalesce  # the machines there build on this module

    known = df if "state" in df.columns else df.withColumn("state", F.lit(None).cast("string"))
    return _lists(known, lambda: Coalesce(selector, ms * 1000, ttl_ms * 1000), keys, time, tie)
