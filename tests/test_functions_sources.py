import socket
import ssl
import subprocess
import threading

import pytest
from pyspark.sql import functions as F

from deltaloom.functions import paths, rules, text, times
from deltaloom.operators import aggregates, stateless, windows
from deltaloom.sources import lines, sockets
from deltaloom.sources.store import Store, series


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_text(spark):
    r = one(spark, a=text.tokens(F.lit(" (The) the well-known 'cat'  -- dogs! ")), b=text.tokens(F.lit(None).cast("string")))
    assert r.a == ["The", "well", "known", "cat", "dogs"] and r.b is None


def test_times(spark):
    r = one(spark, a=times.round_half_up(F.lit(-0.5)), b=times.round_half_up(F.lit(2.5)), p=times.pad_timestamp(F.lit(12)), **times.progress(F.lit(100), F.lit(40), F.lit(60_000), F.lit(1)))
    assert (r.a, r.b, r.p, r.remaining_fmt) == (0, 3, "0000000000012", "1h 00m")
    assert times.hours(2) == 7_200_000 and times.weeks() == 604_800_000


def test_paths(spark):
    tree = F.from_json(F.lit('{"a": {"x": 1, "y": 2}, "b": {}}'), "map<string,map<string,long>>")
    r = one(spark, g=paths.get(tree, "a", "y"), n=paths.get(tree, "c", "y"), k=paths.keys(tree, "a"), s=paths.put(tree, ["c", "z"], F.lit(5).cast("long")), d=paths.remove(tree, "a", "x"), c=paths.clean(tree, 2), h=paths.has(tree, "b", "q"), o=paths.get_or(tree, ["q"], F.create_map().cast("map<string,long>")))
    assert (r.g, r.n, sorted(r.k), r.h, r.o) == (2, None, ["x", "y"], False, {})
    assert r.s["c"] == {"z": 5} and r.d["a"] == {"y": 2} and set(r.c) == {"a"}
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "p string, q string, v int")
    built = paths.build(df, ["p", "q"], "v", "t")
    assert built.first().t == {"a": {"x": 1, "y": 2}, "b": {"x": 3}}
    assert sorted(map(tuple, paths.flat(built, "t", ["p", "q"], "v").collect())) == [("a", "x", 1), ("a", "y", 2), ("b", "x", 3)]


def test_rules_count_null_as_failed(spark):
    df = spark.createDataFrame([(1,), (None,)], "x int")
    got = [(r.isvalid, r.size) for r in rules.check(df, {"size": {"too small": "x > 0"}}).collect()]
    assert got == [(True, None), (False, ["too small"])]


EVENTS = [(1, 1, 0, 5.0), (2, 1, 1000, 5.0), (3, 1, 1000, 7.0), (4, 2, 0, None)]


def test_event_windows_with_ties_and_nulls(spark):
    df = spark.createDataFrame(EVENTS, "event_id long, user_id long, time_us long, value double")
    got = {r.event_id: [x.event_id for x in r.events] for r in windows.contexttime(df, 10, ["user_id"]).collect()}
    assert got == {1: [], 2: [1], 3: [1, 2], 4: []}
    sums = {r.event_id: (r.context_count, r.context_sum) for r in windows.contexttime_sums(df, "value", 10, ["user_id"]).collect()}
    assert sums == {1: (0, 0.0), 2: (1, 5.0), 3: (2, 10.0), 4: (0, 0.0)}
    assert {r.user_id: r.event_id for r in aggregates.max_(df, "value", ["user_id"]).collect()} == {1: 3}
    assert {r.user_id: r.event_id for r in aggregates.min_(df, "value", ["user_id"]).collect()} == {1: 1}
    assert {r.event_id for r in stateless.changed(df, "value", ["user_id"], initial=5.0, has_initial=True).collect()} == {3, 4}
    assert aggregates.stats(df.limit(0), "value", ["user_id"]).count() == 0
    assert [r.event_id for r in windows.groupcount(df, 2, ["user_id"]).select(F.explode("events.event_id").alias("event_id")).collect()] == [1, 2]


def test_ndjson_keeps_good_lines(spark, tmp_path):
    (tmp_path / "x").write_text('{"a": 1}\nnot json\n\n{"a": 2}\n')
    good, bad = lines.read_ndjson(spark, str(tmp_path / "x"), "a long")
    assert sorted(r.a for r in good.collect()) == [1, 2] and [r.line for r in bad.collect()] == ["not json"]
    lines.write_ndjson(good, str(tmp_path / "out"))
    assert lines.read_ndjson(spark, str(tmp_path / "out"), "a long")[0].count() == 2


def test_csv_leaves_null_text(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Id,Fax,Price\n1,NULL,1.25\n")
    r = lines.read_csv(spark, str(tmp_path / "s.csv"), {"Id": "int"}, ["Price"]).first()
    assert (r.Id, r.Fax, r.Price) == (1, "NULL", 125.0)
    assert [x.value for x in lines.counter(spark, 6, 2, 2).collect()] == [2, 4, 6]


def test_store_and_series(spark):
    s = Store(spark.createDataFrame([("p·a", "1"), ("p·b", "2"), ("q·a", "3")], "key string, value string"), "p·")
    assert [tuple(r) for r in s.scan(gt="a").collect()] == [("b", "2")]
    t = s.batch(put=spark.createDataFrame([("c", "9"), ("a", "8")], "key string, value string"), del_=spark.createDataFrame([("b", "")], "key string, value string"))
    assert [tuple(r) for r in t.scan(reverse=True).collect()] == [("c", "9"), ("a", "8")] and t.df.count() == 3
    df = spark.createDataFrame([(5, "b"), (5, "a"), (6, "a")], "ts long, id string")
    assert [r.id for r in series(df, 5, 5).collect()] == ["a", "b"] and [r.ts for r in series(df, reverse=True, limit=1).collect()] == [6]


@pytest.mark.parametrize("kind", ["tcp", "udp"])
def test_socket_round_trip(kind):
    server = sockets.Listener(kind, 0, "127.0.0.1")
    client = sockets.Client(kind, server.port)
    client.emit({"a": 1})
    client.emit({"a": 2})
    got = [x for _ in range(10) for x in server.lines(0.05)]
    client.close()
    server.close()
    assert got == ['{"a": 1}', '{"a": 2}']


def test_tls_round_trip(tmp_path):
    made = subprocess.run(["openssl", "req", "-x509", "-newkey", "rsa:2048", "-nodes", "-keyout", tmp_path / "k", "-out", tmp_path / "c", "-days", "1", "-subj", "/CN=localhost", "-addext", "subjectAltName=IP:127.0.0.1"], capture_output=True)
    if made.returncode:
        pytest.skip("no openssl")
    assert sockets.certificate(str(tmp_path / "c")) and sockets.certificate("/nowhere") is None
    server = sockets.Listener("tcp", 0, "127.0.0.1", context=sockets.server_context(str(tmp_path / "c"), str(tmp_path / "k")))
    got, done = [], threading.Event()

    def listen():
        while not done.is_set() and not got:
            got.extend(server.lines(0.1))

    t = threading.Thread(target=listen)
    t.start()
    client = sockets.Client("tcp", server.port, context=sockets.client_context(str(tmp_path / "c")))
    assert isinstance(client.socket, ssl.SSLSocket)
    client.emit({"x": "y"})
    t.join(5)
    done.set()
    client.close()
    server.close()
    assert got == ['{"x": "y"}']


def test_data_source_reads_a_stream(spark, tmp_path):
    spark.dataSource.register(sockets.NdjsonSocket)
    with socket.socket() as s:
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
    df = spark.readStream.format("ndjson_socket").option("port", port).option("wait", "0.3").load()
    q = df.writeStream.format("memory").queryName("lines_in").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        sent = False
        for _ in range(100):
            q.exception() and pytest.fail(str(q.exception()))
            if not sent:
                try:
                    client = sockets.Client("tcp", port)
                    client.emit({"n": 1})
                    client.close()
                    sent = True
                except OSError:
                    pass
            if sent and spark.table("lines_in").count():
                break
            q.awaitTermination(0.3)
        assert [r.value for r in spark.table("lines_in").collect()] == ['{"n": 1}']
    finally:
        q.stop()


def test_batch_writer_sends_rows(spark):
    spark.dataSource.register(sockets.NdjsonSocket)
    server = sockets.Listener("tcp", 0, "127.0.0.1")
    got, done = [], threading.Event()

    def listen():
        while not done.is_set():
            got.extend(server.lines(0.1))

    t = threading.Thread(target=listen)
    t.start()
    spark.range(3).coalesce(1).write.format("ndjson_socket").option("port", server.port).mode("append").save()
    for _ in range(50):
        if len(got) == 3:
            break
        done.wait(0.1)
    done.set()
    t.join()
    server.close()
    assert sorted(got) == ['{"id": 0}', '{"id": 1}', '{"id": 2}']
