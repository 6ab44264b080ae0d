"""Streaming runs of the stateful machines and of windowed aggregates.

A watermark is ours: batch runs never drop an event, streams drop those later
than the delay that the caller allows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from deltaloom.operators.stateful import Machine

_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def run_machine(df: DataFrame, make: Callable[[], Machine], keys: Iterable[str], schema: str, row: Callable[[tuple, int, object], dict], time: str = "ts", tie: str = "event_id", delay: str = "0 seconds") -> DataFrame:
    """Run a machine for each key of a stream; timers fire when the watermark passes them.

    ``row(key, time in µs, output)`` makes a row of each output. A machine's
    state is kept pickled, its settings (selectors, functions) are not.

    Events of one micro-batch are taken in order of time. One that comes in a
    later micro-batch than events after it, but within the watermark, is taken
    when it comes: machines see it as the next event, with its own time. With a
    trigger that reads what a source has in order this does not happen; batch
    runs sort all events.
    """
    wanted = [f.name for f in T.StructType.fromDDL(schema).fields]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = make().resume(pickle.loads(state.get[0])) if state.exists else make()
        out: list[dict] = []

        def emit(found) -> None:
            out.extend(row(key, t, x) for t, x in found)

        def upto(t: int) -> None:
            while machine.due is not None and machine.due <= t:
                emit(machine.fire(machine.due))

        if state.hasTimedOut:
            upto(state.getCurrentWatermarkMs() * 1000)
        else:
            rows = pd.concat(list(frames)).sort_values([time, tie], kind="stable")
            for e in rows.to_dict("records"):
                t = (e[time].tz_localize(UTC) if e[time].tzinfo is None else e[time]) - _EPOCH
                t = t // timedelta(microseconds=1)
                upto(t)
                emit(machine.push(t, e))
        state.update((pickle.dumps(machine.state()),))
        if machine.due is not None:
            state.setTimeoutTimestamp(max(-(-machine.due // 1000), state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=wanted)

    return df.withWatermark(time, delay).groupBy(*keys).applyInPandasWithState(step, schema, "machine binary", "append", GroupStateTimeout.EventTimeTimeout)


def grouptime(df: DataFrame, ms: int, keys: Iterable[str], aggregates: dict[str, Column], time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Tumbling windows on the epoch, given out when the watermark has passed them."""
    window = F.window(time, f"{ms} milliseconds")
    return df.withWatermark(time, delay).groupBy(*keys, window).agg(*[c.alias(k) for k, c in aggregates.items()]).select(*keys, F.unix_micros(F.col("window.start")).alias("window_us"), *aggregates)


def settle(df: DataFrame, ms: int, keys: Iterable[str], time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """The last event before each silence of ``ms``, by session windows."""
    session = F.session_window(time, f"{ms} milliseconds")
    return df.withWatermark(time, delay).groupBy(*keys, session).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(time)).alias("e")).select(*keys, "e.*")


def to_console(df: DataFrame, channel: str = "log") -> DataFrame:
    """Tee: call from foreachBatch to print a batch under a channel (log, error or trace) and pass it on."""
    print(f"[{channel}]")
    df.show(truncate=False)
    return df
