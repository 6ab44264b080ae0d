"""Machines against simulators that replay timers and events in one sorted list."""

import math
import random

import pytest
from pyspark.sql import functions as F

from deltaloom.operators import stateful


def rows(seed, n=120, keys=3):
    rnd = random.Random(seed)
    return [(i, rnd.randrange(keys), rnd.randrange(0, 60_000) * 1000, float(rnd.randrange(-5, 6))) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "event_id long, user_id long, time_us long, value double")


def by_key(data):
    out = {}
    for e in sorted(data, key=lambda e: (e[2], e[0])):
        out.setdefault(e[1], []).append(e)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_sampletime(spark, seed):
    data, want = rows(seed), set()
    for es in by_key(data).values():
        last = es[0][2]
        for e in es[1:]:
            if e[2] - last > 3_000_000:
                want.add(e[0])
                last = e[2]
    assert {r.event_id for r in stateful.sampletime(frame(spark, data), 3000, ["user_id"]).collect()} == want


@pytest.mark.parametrize("seed", [3, 4])
def test_debounce(spark, seed):
    data, want, ms = rows(seed), set(), 2_000_000
    for es in by_key(data).values():
        last, held = None, None
        for e in [*es, (None, None, 1 << 60, None)]:
            if held and last + ms <= e[2]:
                want.add((held[0], last + ms))
                last, held = last + ms, None
            if e[0] is None:
                break
            if last is None or e[2] - last > ms:
                want.add((e[0], e[2]))
                last, held = e[2], None
            else:
                held = e
    assert {(r.event_id, r.fired_us) for r in stateful.debounce(frame(spark, data), 2000, ["user_id"]).collect()} == want


@pytest.mark.parametrize("n", [1, 3])
def test_throttle_and_rollup(spark, n):
    data, passed, lists, ms = rows(5, 200), set(), [], 4_000_000
    for es in by_key(data).values():
        window, closed, rest = [], None, []
        for e in [*es, (None, None, 1 << 60, None)]:
            if closed is not None and e[2] >= closed:
                lists.append(tuple(x[0] for x in rest))
                window, closed, rest = [], None, []
            if e[0] is None:
                break
            if closed is not None:
                rest.append(e)
                continue
            window = [x for x in [*window, e] if e[2] - x[2] < ms]
            if len(window) <= n:
                passed.add(e[0])
                lists.append((e[0],))
            else:
                closed, rest = window[0][2] + ms, [e]
    df = frame(spark, data)
    assert {r.event_id for r in stateful.throttle(df, n, 4000, ["user_id"]).collect()} == passed
    got = [tuple(x.event_id for x in r.events) for r in stateful.rollup(df, n, 4000, ["user_id"]).collect()]
    assert sorted(got) == sorted(lists)


@pytest.mark.parametrize("n", [None, 1, 3])
def test_batch_and_anchored_windows(spark, n):
    data, want, ms = rows(6, 150), [], 5_000_000
    for es in by_key(data).values():
        held, due = [], None
        for e in [*es, (None, None, 1 << 60, None)]:
            while due is not None and due <= e[2]:
                if held:
                    want.append((due, tuple(x[0] for x in held)))
                    held, due = [], due + ms
                else:
                    due = None
            if e[0] is None:
                break
            held.append(e)
            if due is None:
                due = e[2] + ms
            if n and len(held) == n:
                want.append((e[2], tuple(x[0] for x in held)))
                held, due = [], e[2] + ms
    df = frame(spark, data)
    out = stateful.batch(df, n, 5000, ["user_id"]) if n else stateful.grouptime_anchored(df, 5000, ["user_id"])
    assert sorted((r.fired_us, tuple(x.event_id for x in r.events)) for r in out.collect()) == sorted(want)


def test_averages(spark):
    data = rows(7)
    plain, timed = {}, {}
    for es in by_key(data).values():
        cur, ew, last = None, None, None
        for e in es:
            cur = e[3] * 0.5 + (cur or e[3]) * 0.5
            plain[e[0]] = cur
            ew = e[3] if last is None else (1 - math.exp(-(e[2] - last) / 9e6)) * e[3] + math.exp(-(e[2] - last) / 9e6) * ew
            last = e[2]
            timed[e[0]] = ew
    df = frame(spark, data)
    assert {r.event_id: r.metric for r in stateful.ewmatimeless(df, "value", 0.5, ["user_id"]).collect()} == pytest.approx(plain)
    assert {r.event_id: r.metric for r in stateful.ewma(df, "value", 9000, ["user_id"]).collect()} == pytest.approx(timed)


def test_no_events_and_null_values(spark):
    empty = frame(spark, [])
    assert stateful.rollup(empty, 1, 10, ["user_id"]).count() == 0
    some = frame(spark, [(1, 1, 0, None), (2, 1, 1000, 4.0)])
    assert [r.metric for r in stateful.ewma(some, "value", 1, ["user_id"]).orderBy("event_id").collect()] == [None, 4.0]


def test_without_keys_all_events_share_one_machine(spark):
    df = frame(spark, [(i, i % 2, i * 1_000_000, 1.0) for i in range(10)])
    assert stateful.sampletime(df, 1500, []).select(F.count("*")).first()[0] == 4
