"""Hierarchies and transactions: customers below nations below regions, orders as transactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltaloom.operators import graph, ledger
from deltaloom.operators.operations import Operation, Operations
from deltaloom.plans.registry import query
from deltaloom.session import load
from deltaloom.sources.store import Store


def _edges(spark, d):
    nations = load(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("src"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("dst"))
    customers = load(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("src"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("dst"))
    return nations.unionByName(customers)


_G = """WITH e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
g AS (SELECT 0 AS depth, src, dst FROM e UNION SELECT 1 AS depth, a.src, b.dst FROM e a JOIN e b ON a.dst = b.src)"""


@query(f"{_G} SELECT depth, src, dst FROM g")
def graph_closure(spark, d):
    return graph.closure(_edges(spark, d))


@query(f"{_G} SELECT 0 AS depth, 'n3' AS src, 'r2' AS dst UNION ALL SELECT 1 AS depth, src, 'r2' AS dst FROM g WHERE dst = 'n3' AND depth = 0")
def graph_put_delta(spark, d):
    return graph.put_delta(graph.closure(_edges(spark, d)), "n3", "r2")


@query(f"{_G} SELECT 0 AS depth, 'n3' AS src, 'r3' AS dst FROM e WHERE src = 'n3' AND dst = 'r3' UNION ALL SELECT 1 AS depth, g.src, 'r3' AS dst FROM g JOIN e ON e.src = 'n3' AND e.dst = 'r3' WHERE g.dst = 'n3' AND depth = 0")
def graph_del_delta(spark, d):
    return graph.del_delta(graph.closure(_edges(spark, d)), "n3", "r3")


@query(f"{_G} SELECT depth, src, dst FROM g WHERE depth = 0 AND src NOT IN ('n3', 'n4')")
def graph_batch(spark, d):
    tree = graph.closure(_edges(spark, d))
    return graph.batch(tree.filter("depth = 0"), del_=tree.filter("src IN ('n3', 'n4')"))


@query(f"{_G} SELECT DISTINCT dst AS node FROM g WHERE src IN ('c1', 'c2', 'c3', 'n7')")
def graph_ancestors(spark, d):
    return graph.ancestors(graph.closure(_edges(spark, d)), ["c1", "c2", "c3", "n7"])


@query(f"{_G} SELECT DISTINCT src AS node FROM g WHERE dst IN ('r1', 'n7') AND depth = 1")
def graph_descendants(spark, d):
    return graph.descendants(graph.closure(_edges(spark, d)), ["r1", "n7"], [1])


@query(f"{_G} SELECT depth, dst AS node FROM g WHERE src = 'c1'")
def graph_ancestor_levels(spark, d):
    return graph.ancestor_levels(graph.closure(_edges(spark, d)), "c1")


@query(f"{_G} SELECT coalesce(max(src = 'c1' AND dst = 'r4'), false) AS found FROM g")
def graph_hasancestor(spark, d):
    return graph.has_ancestor(graph.closure(_edges(spark, d)), "c1", "r4")


@query("SELECT 1 AS max_depth")
def graph_maxdepth(spark, d):
    return graph.max_depth(graph.closure(_edges(spark, d)))


@query(f"{_G} SELECT src AS node FROM e WHERE dst = 'n7'")
def links_children(spark, d):
    return graph.children(_edges(spark, d), "n7")


def _transactions(spark, d):
    """Orders as transactions of their customer, with another dimension for the priority."""
    measures = F.create_map(F.lit("spend"), F.round("o_totalprice", 2), F.lit("n"), F.lit(1.0))
    dims = F.array(F.concat(F.lit("c"), F.col("o_custkey")), F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)))
    return load(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts"), measures.alias("measures"), dims.alias("dimensions"))


_TX = """WITH t AS (SELECT o_orderkey AS id, round(o_totalprice, 2) AS v, 'c' || o_custkey AS c, 'p' || substr(o_orderpriority, 1, 1) AS p FROM orders),
up AS (SELECT 'c' || c_custkey AS c, 'c' || c_custkey AS d FROM customer UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'c' || c_custkey, 'r' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey),
x AS (SELECT id, v, coalesce(d, t.c) AS d FROM t LEFT JOIN up ON up.c = t.c UNION ALL SELECT id, v, p AS d FROM t)"""


@query(f"{_TX} SELECT d AS dimension, 'spend' AS measure, round(sum(v), 2) AS total, count(*) AS transactions FROM x GROUP BY d UNION ALL SELECT d, 'n', count(*), count(*) FROM x GROUP BY d")
def ledger_rollup(spark, d):
    return ledger.rollup(_transactions(spark, d), graph.closure(_edges(spark, d))).withColumn("total", F.round("total", 2))


def _change(spark, d):
    """Every third order costs 10 more, every seventh moves to another priority, every eleventh is deleted."""
    now = _transactions(spark, d)
    i = F.col("id").cast("long")
    moved = F.when(i % 7 == 0, F.transform("dimensions", lambda x: F.when(x.startswith("p"), F.lit("p9")).otherwise(x))).otherwise(F.col("dimensions"))
    spend = F.col("measures")["spend"]
    measures = F.create_map(F.lit("spend"), F.when(i % 3 == 0, spend + 10).otherwise(spend), F.lit("n"), F.col("measures")["n"])
    after = now.filter(i % 11 != 0).select("id", "ts", measures.alias("measures"), moved.alias("dimensions"))
    return ledger.changes(now, after)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, 10.0 AS delta FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 11 <> 0 UNION ALL SELECT CAST(o_orderkey AS VARCHAR), round(-round(o_totalprice, 2), 2) FROM orders WHERE o_orderkey % 11 = 0")
def ledger_diff_measures(spark, d):
    diff = ledger.diff_measures(F.col("prev.measures"), F.col("now.measures"))
    rows = _change(spark, d).select(F.col("prev.id").alias("id"), diff.alias("m"))
    return rows.filter("m['spend'] is not null").select("id", F.round(F.col("m")["spend"], 2).alias("delta"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, 'p9' AS put, 'p' || substr(o_orderpriority, 1, 1) AS del, 'c' || o_custkey AS same FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 11 <> 0")
def ledger_diff_dimensions(spark, d):
    sides = ledger.diff_dimensions(F.col("prev.dimensions"), F.col("now.dimensions"))
    rows = _change(spark, d).filter("now is not null").select(F.col("prev.id").alias("id"), *[F.array_join(c, ",").alias(k) for k, c in sides.items()])
    return rows.filter("put <> ''")


@query(
    """WITH t AS (SELECT o_orderkey AS id, round(o_totalprice, 2) AS v, 'p' || substr(o_orderpriority, 1, 1) AS p FROM orders),
    x AS (SELECT p AS d, -v AS s, CAST(-1 AS DOUBLE) AS n FROM t WHERE id % 3 = 0 OR id % 7 = 0 OR id % 11 = 0
          UNION ALL SELECT CASE WHEN id % 7 = 0 THEN 'p9' ELSE p END, CASE WHEN id % 3 = 0 THEN v + 10 ELSE v END, CAST(1 AS DOUBLE) FROM t WHERE (id % 3 = 0 OR id % 7 = 0) AND id % 11 <> 0)
    SELECT d AS dimension, round(sum(s), 2) AS spend, round(sum(n), 2) AS n FROM x GROUP BY d"""
)
def ledger_change_transactions(spark, d):
    out = ledger.change_transactions(_change(spark, d), graph.closure(_edges(spark, d))).filter("dimension LIKE 'p%'")
    return out.groupBy("dimension").agg(F.round(F.sum(F.when(F.col("measure") == "spend", F.col("delta"))), 2).alias("spend"), F.round(F.sum(F.when(F.col("measure") == "n", F.col("delta"))), 2).alias("n"))


@query(
    """WITH m AS (SELECT n_nationkey, n_regionkey, CASE WHEN n_nationkey % 5 = 0 THEN (n_regionkey + 1) % 5 ELSE n_regionkey END AS to_r FROM nation),
    s AS (SELECT n_regionkey, to_r, sum(round(o_totalprice, 2)) AS v FROM orders JOIN customer ON c_custkey = o_custkey JOIN m ON n_nationkey = c_nationkey WHERE n_regionkey <> to_r GROUP BY ALL),
    x AS (SELECT 'r' || n_regionkey AS d, -v AS v FROM s UNION ALL SELECT 'r' || to_r, v FROM s)
    SELECT d AS dimension, round(sum(v), 2) AS delta FROM x GROUP BY d HAVING abs(sum(v)) > 1e-9"""
)
def ledger_change_dimensions(spark, d):
    edges = _edges(spark, d)
    out = ledger.change_dimensions(_transactions(spark, d), edges, _moved(edges))
    return out.filter("measure = 'spend'").select("dimension", F.round("delta", 2).alias("delta"))


_CHANGED = _TX + """, w AS (SELECT id, d, CASE WHEN d LIKE 'p%' AND id % 7 = 0 THEN 'p9' ELSE d END AS d2, v, CASE WHEN id % 3 = 0 THEN v + 10 ELSE v END AS v2 FROM x WHERE id % 3 = 0 OR id % 7 = 0 OR id % 11 = 0),
y AS (SELECT d, -v AS s, -1 AS n FROM w UNION ALL SELECT d2, v2, 1 FROM w WHERE id % 11 <> 0)"""


@query(f"{_CHANGED} SELECT d AS dimension, round(sum(s), 2) AS spend, CAST(sum(n) AS DOUBLE) AS n FROM y GROUP BY d")
def ledger_change_rolled(spark, d):
    """What the changes make of all members, ancestors included."""
    out = ledger.change_transactions(_change(spark, d), graph.closure(_edges(spark, d)))
    return out.groupBy("dimension").agg(F.round(F.sum(F.when(F.col("measure") == "spend", F.col("delta"))), 2).alias("spend"), F.round(F.sum(F.when(F.col("measure") == "n", F.col("delta"))), 2).alias("n"))


@query(
    """WITH t AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey % 3 = 0 AS dearer, o_orderkey % 7 = 0 AS moved, o_orderkey % 11 = 0 AS gone, round(o_totalprice, 2) AS v, 'c' || o_custkey AS c, 'p' || substr(o_orderpriority, 1, 1) AS p FROM orders)
    SELECT id, c AS dimension, 10.0 AS spend FROM t WHERE dearer AND NOT gone UNION ALL SELECT id, p, 10.0 FROM t WHERE dearer AND NOT gone AND NOT moved
    UNION ALL SELECT id, 'p9', round(v + CASE WHEN dearer THEN 10 ELSE 0 END, 2) FROM t WHERE moved AND NOT gone UNION ALL SELECT id, p, -v FROM t WHERE moved AND NOT gone
    UNION ALL SELECT id, c, -v FROM t WHERE gone UNION ALL SELECT id, p, -v FROM t WHERE gone"""
)
def ledger_diff_transaction(spark, d):
    return ledger.diff_rows(_change(spark, d)).filter("measure = 'spend'").select("id", "dimension", F.round("delta", 2).alias("spend"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'del' ELSE 'same' END AS change FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 11 = 0")
def ledger_changed_members(spark, d):
    now = load(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), "o_totalprice")
    i = F.col("id").cast("long")
    after = now.filter(i % 11 != 0).select("id", F.when((i % 3 == 0) | (i % 7 == 0), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"))
    return ledger.changed_members(now, after)


def _moved(edges):
    n = F.substring("src", 2, 9).cast("long")
    return edges.select("src", F.when(F.col("src").startswith("n") & (n % 5 == 0), F.concat(F.lit("r"), (F.substring("dst", 2, 9).cast("long") + 1) % 5)).otherwise(F.col("dst")).alias("dst"))


@query(
    """WITH m AS (SELECT 'n' || n_nationkey AS n, 'r' || n_regionkey AS a, 'r' || ((n_regionkey + 1) % 5) AS b FROM nation WHERE n_nationkey % 5 = 0),
    c AS (SELECT 'c' || c_custkey AS c, 'n' || c_nationkey AS n FROM customer)
    SELECT 'del' AS change, 0 AS depth, n AS src, a AS dst FROM m UNION ALL SELECT 'put', 0, n, b FROM m UNION ALL SELECT 'del', 1, c, a FROM c JOIN m USING (n) UNION ALL SELECT 'put', 1, c, b FROM c JOIN m USING (n)"""
)
def ledger_link_deltas(spark, d):
    edges = _edges(spark, d)
    return ledger.link_deltas(edges, _moved(edges))


@query(f"{_G} SELECT coalesce(max(src = 'c1' AND dst = 'r4'), false) AS found FROM g")
def graph_hasdescendant(spark, d):
    return graph.has_descendant(graph.closure(_edges(spark, d)), "r4", "c1")


@query("SELECT 0 AS depth, 'n' || n_nationkey AS node, 1 AS times FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 1, 'c' || c_custkey, 1 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2")
def graph_descendant_walks(spark, d):
    return graph.descendant_walks(_edges(spark, d), "r2").withColumn("times", F.col("times").cast("int"))


@query("SELECT 'c' || c_custkey AS node FROM customer WHERE c_nationkey = 7 AND c_custkey % 2 = 1")
def graph_store_children(spark, d):
    """Edges in a key-value store, some deleted, read back by their parent."""
    edges = _edges(spark, d)
    return graph.GraphStore.of(edges).delete(edges.filter("src like 'c%' and cast(substring(src, 2) as long) % 2 = 0")).children("n7")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE CAST(o_custkey AS VARCHAR) END AS value FROM orders WHERE o_orderkey % 4 <> 0")
def operations_commit(spark, d):
    """Puts and deletes recorded for a store and committed together."""
    rows = load(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_custkey").cast("string").alias("value"))
    ops = Operations({"orders": Store(rows, "")})
    i = F.col("key").cast("long")
    ops.record(Operation("orders", put=rows.filter((i % 3 == 0) & (i % 4 != 0)).withColumn("value", F.lit("x"))))
    ops.record(Operation("orders", delete=rows.filter(i % 4 == 0).select("key")))
    return ops.commit()["orders"].scan()
