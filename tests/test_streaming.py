"""Streams over dropped files give what batch runs give, for all that the watermark has passed."""

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from deltaloom.operators import stateful
from deltaloom.streaming import machines as m
from deltaloom.streaming import twins


def run(spark, df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def drops(spark, tmp_path, batches):
    for rows in batches:
        spark.createDataFrame(rows, "event_id long, user_id long, ms long").withColumn("ts", F.timestamp_millis("ms")).drop("ms").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_debounce_machine_matches_batch(spark, tmp_path):
    batches = [[(1, 1, 1000), (2, 1, 1500), (3, 1, 1700)], [(4, 1, 6000), (5, 2, 6100)], [(6, 1, 60_000), (7, 2, 60_000)]]  # a watermark starts at 0: no event may
    flat = [(i, u, ms * 1000) for b in batches for i, u, ms in b]
    want = {(r.event_id, r.fired_us) for r in stateful.debounce(spark.createDataFrame(flat, "event_id long, user_id long, time_us long"), 1000, ["user_id"]).collect()}
    out = twins.run_machine(drops(spark, tmp_path, batches), lambda: stateful.Debounce(1_000_000), ["user_id"], "event_id long, fired_us long", lambda key, t, e: {"event_id": e["event_id"], "fired_us": t})
    assert {(r.event_id, r.fired_us) for r in run(spark, out, tmp_path, "debounced").collect()} == want


def test_windows_and_sessions(spark, tmp_path):
    batches = [[(1, 1, 0), (2, 1, 500)], [(3, 1, 9000)], [(4, 1, 90_000)]]
    df = drops(spark, tmp_path, batches)
    w = run(spark, twins.grouptime(df, 1000, ["user_id"], {"n": F.count(F.lit(1))}, delay="0 seconds"), tmp_path, "grouped")
    assert {(r.window_us, r.n) for r in w.collect()} == {(0, 2), (9_000_000, 1)}
    s = run(spark, twins.settle(df, 2000, ["user_id"], delay="0 seconds"), tmp_path, "settled")
    assert {r.event_id for r in s.collect()} == {2, 3}


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import this module


class All(stateful.Machine):
    """Several machines side by side; outputs carry the name of theirs."""

    settings = ("made",)

    def __init__(self, made):
        self.made, self.own = made, {}

    def each(self):
        for name, make in self.made.items():
            own = make()
            yield name, own.resume(self.own[name]) if name in self.own else own

    def _keep(self, machines):
        self.own = {k: x.state() for k, x in machines.items()}
        dues = [x.due for x in machines.values() if x.due is not None]
        self.due = min(dues, default=None)

    def push(self, t, e):
        machines, out = dict(self.each()), []
        for name, x in machines.items():
            out += [(at, (name, y)) for at, y in x.push(t, e)]
        self._keep(machines)
        return out

    def fire(self, d):
        machines, out = dict(self.each()), []
        for name, x in machines.items():
            if x.due == d:
                out += [(at, (name, y)) for at, y in x.fire(d)]
        self._keep(machines)
        return out


def valued(x):
    return x["value"]


def made():
    s = 1_000_000
    return {
        "contexttime": lambda: m.ContextTime(3 * s), "contextcount": lambda: m.ContextCount(3), "grouptime": lambda: stateful.Batch(None, 4 * s), "groupcount": lambda: m.GroupCount(3), "batch": lambda: stateful.Batch(2, 3 * s),
        "sampletime": lambda: stateful.SampleTime(2 * s), "samplecount": lambda: m.SampleCount(2), "settle": lambda: m.Settle(2 * s), "stable": lambda: m.Stable(4 * s, "value"), "debounce": lambda: stateful.Debounce(2 * s),
        "coalesce": lambda: m.Coalesce("kind", 3 * s, 5 * s), "project": lambda: m.Project([("value", 1.0), lambda e: e["value"] > 1], 4 * s), "rollup": lambda: stateful.Rollup(2, 4 * s), "throttle": lambda: stateful.Throttle(2, 4 * s),
        "ddt": lambda: m.Ddt(lambda e: e["value"]), "fillin": lambda: m.Fillin(2 * s, 5 * s), "changed": lambda: m.Changed("value"),
    }


def shown(name, x):
    """An output as text."""
    es = x if isinstance(x, list) else [x]
    return name + ":" + ",".join("-" if e is None else f"{e['event_id']}{'x' if e.get('state') == 'expired' else ''}{'f' if e.get('filled') is True else ''}{round(e['metric'], 6) if e.get('metric') is not None else ''}" for e in es)


def test_every_machine_gives_on_a_stream_what_it_gives_in_a_batch(spark, tmp_path):
    """Selectors by name and as functions, times to live, timers, over three drops of files, with the state kept between them."""
    import random

    rnd = random.Random(3)
    times = sorted(rnd.sample(range(1000, 60_000, 250), 48))
    events = [(i, i % 2, t, float(rnd.randrange(3)), rnd.choice("ab")) for i, t in enumerate(times)]
    drops_ = [events[:17], events[17:30], events[30:], [(1000, 0, 3_000_000, 0.0, "z")], [(1001, 1, 3_000_000, 0.0, "z")]]
    schema = "event_id long, user_id long, ms long, value double, kind string"
    for rows in drops_:
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_millis("ms")).drop("ms").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = twins.run_machine(stream, lambda: All(made()), ["user_id"], "user_id long, t long, shown string", lambda key, t, x: {"user_id": key[0], "t": t, "shown": shown(*x)})
    end = 3_000_000_000
    got = sorted((r.user_id, r.t, r.shown) for r in run(spark, out, tmp_path, "all_machines").collect() if r.t < end)
    want = []
    for user in (0, 1):
        for name, make in made().items():
            machine = make()
            for i, u, ms, value, kind in [*events, (1000 + user, user, 3_000_000, 0.0, "z")]:
                if u != user:
                    continue
                while machine.due is not None and machine.due <= ms * 1000:
                    want += [(user, t, shown(name, x)) for t, x in machine.fire(machine.due)]
                want += [(user, t, shown(name, x)) for t, x in machine.push(ms * 1000, {"event_id": i, "user_id": u, "value": value, "kind": kind})]
    assert got == sorted(x for x in want if x[1] < end) and {x[2].split(":")[0] for x in got} == set(made())


def test_averages_on_a_stream(spark, tmp_path):
    """The two averages, whose selector's column is made before the machine."""
    rows = [[(1, 1, 1000, 4.0), (2, 1, 3000, 8.0)], [(3, 1, 9000, 2.0)], [(4, 2, 9500, 7.0)]]
    schema = "event_id long, user_id long, ms long, __v double"
    for b in rows:
        spark.createDataFrame(b, schema).withColumn("ts", F.timestamp_millis("ms")).drop("ms").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    flat = spark.createDataFrame([(i, u, t * 1000, v) for b in rows for i, u, t, v in b], "event_id long, user_id long, time_us long, value double")
    for name, make, batch in (("ewma", lambda: stateful.Ewma(5_000_000), stateful.ewma(flat, "value", 5000, ["user_id"])), ("ewmatimeless", lambda: stateful.EwmaTimeless(0.3), stateful.ewmatimeless(flat, "value", 0.3, ["user_id"]))):
        stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = twins.run_machine(stream, make, ["user_id"], "event_id long, metric double", lambda key, t, e: {"event_id": e["event_id"], "metric": e["metric"]})
        got = {r.event_id: round(r.metric, 9) for r in run(spark, out, tmp_path, name).collect()}
        assert got == {r.event_id: round(r.metric, 9) for r in batch.collect()}
