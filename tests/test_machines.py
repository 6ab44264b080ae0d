"""Machines for streams give what the window functions give."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltaloom.hub import Hub
from deltaloom.operators import stateful, stateless, windows
from deltaloom.streaming import machines as m

LONGS = T.StructType([T.StructField("x", T.ArrayType(T.LongType())), T.StructField("t", T.LongType()), T.StructField("metric", T.DoubleType()), T.StructField("filled", T.BooleanType())])


@pytest.fixture(scope="module")
def df(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.randrange(3), rnd.randrange(0, 90_000) * 1000, float(rnd.randrange(4))) for i in range(150)]
    return spark.createDataFrame(rows, "event_id long, user_id long, time_us long, value double").cache()


def ran(df, make):
    def row(key, n, t, x):
        es = x if isinstance(x, list) else [x]
        return {"x": [e and e["event_id"] for e in es], "t": t, "metric": es[0].get("metric") if es and es[0] else None, "filled": es[0].get("filled") if es and es[0] else None}

    return stateful.fold(df, make, ["user_id"], LONGS, row).collect()


def ids(df):
    return sorted(r.event_id for r in df.collect())


value = lambda e: e["value"]  # noqa: E731  pickled by value: workers do not import this module


def test_single_events(df):
    single = lambda make: sorted(r.x[0] for r in ran(df, make))
    k = ["user_id"]
    assert single(lambda: m.Changed(value)) == ids(stateless.changed(df, "value", k))
    assert single(lambda: m.SampleCount(4)) == ids(windows.samplecount(df, 4, k))
    assert single(lambda: m.Settle(2_000_000)) == ids(windows.settle(df, 2000, k))
    assert single(lambda: m.Stable(4_000_000, value)) == ids(windows.stable(df, 4000, "value", k))
    got = {r.x[0]: r.metric for r in ran(df, lambda: m.Ddt(value))}
    assert got == pytest.approx({r.event_id: r.metric for r in windows.ddt(df, "value", k).collect()})


def test_lists(df):
    lists = lambda make: sorted(tuple(r.x) for r in ran(df, make))
    k, own = ["user_id"], lambda d: sorted(tuple(x.event_id for x in r.events) for r in d.collect())
    assert lists(lambda: m.GroupCount(5)) == own(windows.groupcount(df, 5, k))
    assert lists(lambda: m.ContextCount(3)) == own(windows.contextcount(df, 3, k))
    assert lists(lambda: m.ContextTime(3_000_000)) == own(windows.contexttime(df, 3000, k))


def test_fillin_and_project(df):
    k = ["user_id"]
    want = sorted((r.event_id, r.time_us, r.filled) for r in windows.fillin(df, 700, k, "3000").collect())
    assert sorted((r.x[0], r.t, r.filled) for r in ran(df, lambda: m.Fillin(700_000, 3_000_000))) == want
    slots = windows.project(df, ["value = 1", "value > 1"], "2000", k).select("slot0.event_id", F.col("slot1.event_id").alias("b"))
    got = sorted(map(str, (tuple(r.x) for r in ran(df, lambda: m.Project([lambda e: e["value"] == 1, lambda e: e["value"] > 1], 2_000_000)))))
    assert got == sorted(str(tuple(r)) for r in slots.collect())


def test_lake_expires_once():
    lake = m.Coalesce(lambda e: e["k"], 10, 25)
    lake.push(0, {"k": "a"})
    lake.push(5, {"k": "b", "state": "expired"})
    seen = []
    while lake.due is not None:
        seen += lake.fire(lake.due)
    assert [t for t, _ in seen] == [10, 20, 30] and seen[-1][1] == [{"k": "a", "state": "expired"}]


def test_events_own_times_to_live(df):
    lake = m.Coalesce("k", 10, 1_000_000)
    lake.push(0, {"k": "a", "ttl": 0.015})
    lake.push(0, {"k": "b", "ttl": None})
    assert set(lake.all()) == {"a", "b"}
    out = lake.fire(10) + lake.fire(20)
    assert [[e.get("state") for e in x] for _, x in out] == [[None, None], ["expired", None]] and set(lake.all()) == {"b"}
    slots = m.Project(["x", ("k", 2)], None)
    seen = [slots.push(t, e)[0][1] for t, e in ((0, {"x": True, "k": 1, "ttl": 0.005}), (4, {"x": False, "k": 2}), (5, {"x": None, "k": 3}), (6, {"x": False, "k": 3}), (7, {"x": False, "k": 4}))]
    assert [[s and s["k"] for s in x] for x in seen] == [[1, None], [1, 2], [1, None], [1, None], [None, None]]
    fill = m.Fillin(10, 1_000_000, lambda e: {"again": e["k"]})
    fill.push(0, {"k": 1, "ttl": 0.025})
    assert [fill.fire(d) for d in (10, 20, 30)] == [[(10, {"again": 1, "filled": True})], [(20, {"again": 1, "filled": True})], []]


def test_coalesce_in_a_batch(df):
    rows = stateful.coalesce(df, "value", 2000, ["user_id"], 3000).collect()
    assert rows and all(len({e.value for e in r.events}) == len(r.events) for r in rows)
    last = {}
    for r in sorted(rows, key=lambda r: (r.user_id, r.group_no)):
        for e in r.events:
            assert (e.state == "expired") == (e.time_us + 3_000_000 < r.fired_us)
        last[r.user_id] = r
    assert all(e.state == "expired" for r in last.values() for e in r.events)


def test_hub():
    hub, heard = Hub({"first": lambda: "1"}), []
    stop = hub.on("x", heard.append)
    hub.unhandled(lambda name, *a: heard.append((name, a)))
    child = hub.child({"own": lambda: "mine"})
    child.emit("x", 1)  # not handled by the child
    child.emit("y", 2)
    assert child.emit("own") == ["mine"] and hub.emit("first") == ["1"]
    child.on("x", lambda v: None)
    child.emit("x", 5)  # handled by the child: the parent does not hear of it
    stop()
    hub.emit("x", 3)  # a name that had a listener is not unhandled
    assert heard == [1, ("y", (2,))]
    last = []
    start = hub.effect(lambda h: (h.on("z", heard.append), lambda: last.append(1))[1])
    end = start()
    hub.emit("z", 9)
    end()
    hub.emit("z", 10)
    assert heard[-1] == 9 and last == [1]
