"""Stores that are written and read again, graphs in them, and operations over several."""

import pytest

from deltaloom.hub import Hub
from deltaloom.operators import graph, ledger
from deltaloom.operators.operations import Operation, Operations
from deltaloom.sources.store import Series, Store


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_graph_is_written_and_opened_again(spark, tmp_path):
    edges = spark.createDataFrame([("d", "b"), ("d", "c"), ("b", "a"), ("c", "a"), (None, "a")], "src string, dst string")
    one = graph.GraphStore.of(edges)
    one.store.write(str(tmp_path / "one"))
    back = graph.GraphStore.open(spark, str(tmp_path / "one"))
    assert rows(back.edges()) == [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c")]
    assert rows(back.parents("d")) == [("b",), ("c",)] and rows(back.children("a")) == [("b",), ("c",)] and rows(back.children("d")) == []
    two = back.delete(spark.createDataFrame([("d", "b")], "src string, dst string")).put(spark.createDataFrame([("e", "d"), ("b", "a")], "src string, dst string"))
    assert rows(two.edges()) == [("b", "a"), ("c", "a"), ("d", "c"), ("e", "d")]
    assert (2, "e", "a") in rows(two.closure()) and graph.max_depth(two.closure()).first()[0] == 2


def test_walks_count_paths_and_refuse_cycles(spark):
    edges = spark.createDataFrame([("d", "b"), ("d", "c"), ("b", "a"), ("c", "a"), ("d", "a")], "src string, dst string")
    assert rows(graph.ancestor_walks(edges, "d")) == [(0, "a", 1), (0, "b", 1), (0, "c", 1), (1, "a", 2)]
    assert rows(graph.descendant_walks(edges, "a")) == [(0, "b", 1), (0, "c", 1), (0, "d", 1), (1, "d", 2)]
    assert rows(graph.descendant_walks(edges, "d")) == []
    loop = spark.createDataFrame([("x", "y"), ("y", "z"), ("z", "y")], "src string, dst string")
    with pytest.raises(ValueError):
        graph.ancestor_walks(loop, "x")
    with pytest.raises(ValueError):
        graph.closure(loop)


def test_a_deep_chain_has_a_closure(spark):
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(12)], "src string, dst string")
    assert graph.closure(edges).count() == 78
    with pytest.raises(ValueError):
        graph.closure(edges, max_depth=5)


def test_series(spark, tmp_path):
    base = Series(spark.createDataFrame([(1, 10, "a"), (2, 30, "b"), (3, 20, "c")], "id long, ts long, v string"))
    new = base.put(spark.createDataFrame([(2, 5, "x"), (2, 6, "y"), (4, 20, "d")], "id long, ts long, v string")).delete(spark.createDataFrame([(1,), (9,)], "id long"))
    new.write(str(tmp_path / "s"))
    back = Series.open(spark, str(tmp_path / "s"))
    assert [tuple(r) for r in back.read().collect()] == [(2, 6, "y"), (3, 20, "c"), (4, 20, "d")]
    assert [r.id for r in back.read(gt=20, reverse=True, limit=1).collect()] == [4] and back.get(3).first().v == "c"


def test_operations_are_made_together_or_not_at_all(spark):
    kv = lambda *x: spark.createDataFrame(x, "key string, value string")
    hub, heard = Hub(), []
    ops = Operations({"a": Store(kv(("1", "x"))), "b": Store(kv(("p:1", "y")), "p:")}, hub)
    hub.on("operations committed", lambda: heard.append("committed"))
    ops.record(Operation("a", put=kv(("2", "z")), on_cancel=lambda: heard.append("a cancelled")))
    ops.after_commit(lambda: heard.append("never"))
    ops.cancel()
    assert heard == ["a cancelled"] and rows(ops.stores["a"].scan()) == [("1", "x")]
    ops.record(Operation("a", put=kv(("2", "z")), delete=kv(("1", "")).select("key"), on_commit=lambda: heard.append("a done")))
    ops.record(Operation("b", put=kv(("2", "w"))))
    ops.after_commit(lambda: heard.append("once"))
    assert rows(ops.stores["a"].scan()) == [("1", "x")]  # nothing before the commit
    ops.commit()
    ops.commit()
    assert ops.stores["a"].readall() == [("2", "z")] and ops.stores["b"].readall() == [("1", "y"), ("2", "w")]
    assert heard == ["a cancelled", "a done", "committed", "once", "committed"]
    with pytest.raises(KeyError):
        ops.record(Operation("c"))


def test_equal_maps_in_another_order_are_no_change(spark):
    make = lambda sql: spark.sql(f"SELECT 'k' AS id, {sql} AS m, array('x') AS d")
    assert ledger.changes(make("map('a', 1, 'b', 2)"), make("map('b', 2, 'a', 1)")).count() == 0
    assert ledger.changes(make("map('a', 1, 'b', 2)"), make("map('b', 2, 'a', 3)")).count() == 1
    assert rows(ledger.changed_members(make("map('a', 1)"), make("map('a', 2)"))) == [("k", "same")]
