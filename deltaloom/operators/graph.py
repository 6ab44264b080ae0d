"""Closures of directed acyclic graphs of ``src`` -> ``dst`` edges (child to parent).

A closure has (depth, src, dst), depth 0 for edges; a pair may stand at
several depths. Loops join the newest level with the edges until a level is
empty; a level is cut off in the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.session import checkpointed
from deltaloom.sources.store import Store


def closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """All ancestors of all nodes, however deep. A cycle, of which some node is its own ancestor, raises ValueError, and so does a closure deeper than ``max_depth`` if that is given."""
    base = checkpointed(edges.select("src", "dst").filter("src is not null and dst is not null").distinct())
    level = base.select(F.lit(0).alias("depth"), "src", "dst")
    out, depth = level, 0
    up = base.select(F.col("src").alias("__m"), F.col("dst").alias("__d"))
    while True:
        n, loop = level.agg(F.count(F.lit(1)), F.max(F.col("src") == F.col("dst"))).first()
        if loop:
            raise ValueError("a cycle of edges")
        if not n:
            return out
        if max_depth is not None and depth > max_depth:
            raise ValueError(f"deeper than {max_depth}")
        out, depth = (out.unionByName(level) if depth else level), depth + 1
        level = checkpointed(level.join(up, level.dst == up["__m"]).select(F.lit(depth).alias("depth"), "src", F.col("__d").alias("dst")).distinct())


def _product(tree: DataFrame, src: str, dst: str) -> DataFrame:
    """(depth, descendant, ancestor) over an edge: its ends with all below and above them.

    The ancestors of one node go as one array to each of the other node's
    descendants, which stay where they are.
    """
    node = tree.schema["src"].dataType
    above = tree.filter(F.col("src") == dst).agg(F.collect_set(F.struct((F.col("depth") + 1).alias("b"), F.col("dst").alias("up"))).alias("above"))
    ups = F.concat(F.array(F.struct(F.lit(0).alias("b"), F.lit(dst).cast(node).alias("up"))), above.scalar())
    rows = tree.filter(F.col("dst") == src).select((F.col("depth") + 1).alias("a"), "src")
    rows = rows.unionByName(tree.sparkSession.range(1).select(F.lit(0).alias("a"), F.lit(src).cast(node).alias("src")))
    each = rows.withColumn("ups", ups).select("a", "src", F.explode("ups").alias("u"))
    return each.select((F.col("a") + F.col("u.b")).alias("depth"), "src", F.col("u.up").alias("dst")).distinct()


def _has(tree: DataFrame, src: str, dst: str) -> DataFrame:
    return tree.filter((F.col("depth") == 0) & (F.col("src") == src) & (F.col("dst") == dst)).select(F.lit(1).alias("__e")).limit(1)


def put_delta(tree: DataFrame, src: str, dst: str) -> DataFrame:
    """Tuples that a new edge adds; none if it is there."""
    return _product(tree, src, dst).withColumn("__e", F.lit(1)).join(_has(tree, src, dst), "__e", "left_anti").drop("__e")


def del_delta(tree: DataFrame, src: str, dst: str) -> DataFrame:
    """Tuples that an edge's removal takes, other paths left aside; none if it is not there."""
    return _product(tree, src, dst).withColumn("__e", F.lit(1)).join(_has(tree, src, dst), "__e", "left_semi").drop("__e")


def batch(tree: DataFrame, put: DataFrame | None = None, del_: DataFrame | None = None) -> DataFrame:
    """Apply tuples to a closure."""
    out = tree if del_ is None else tree.join(del_, ["depth", "src", "dst"], "left_anti")
    return out if put is None else out.unionByName(put).distinct()


def change(edges: DataFrame, put: DataFrame | None = None, del_: DataFrame | None = None) -> DataFrame:
    """Edges after a change; take :func:`closure` of them, since tuples of a removed edge may have other paths."""
    return batch(edges.select(F.lit(0).alias("depth"), "src", "dst"), *(None if x is None else x.select(F.lit(0).alias("depth"), "src", "dst") for x in (put, del_))).select("src", "dst")


def ancestors(tree: DataFrame, nodes: Iterable, depths: Iterable[int] | None = None) -> DataFrame:
    """Distinct ancestors (``node``) of some nodes, at the depths given."""
    rows = tree.filter(F.col("src").isin(list(nodes)))
    return (rows if depths is None else rows.filter(F.col("depth").isin(list(depths)))).select(F.col("dst").alias("node")).distinct()


def descendants(tree: DataFrame, nodes: Iterable, depths: Iterable[int] | None = None) -> DataFrame:
    """Distinct descendants (``node``) of some nodes, at the depths given."""
    rows = tree.filter(F.col("dst").isin(list(nodes)))
    return (rows if depths is None else rows.filter(F.col("depth").isin(list(depths)))).select(F.col("src").alias("node")).distinct()


def ancestor_levels(tree: DataFrame, node) -> DataFrame:
    """Ancestors of a node level by level, one row a depth at which each stands."""
    return tree.filter(F.col("src") == node).select("depth", F.col("dst").alias("node")).orderBy("depth", "node")


def parents(edges: DataFrame, child) -> DataFrame:
    return edges.filter(F.col("src") == child).select(F.col("dst").alias("node"))


def children(edges: DataFrame, parent) -> DataFrame:
    return edges.filter(F.col("dst") == parent).select(F.col("src").alias("node"))


def has_ancestor(tree: DataFrame, node, ancestor) -> DataFrame:
    """One row: whether an ancestor is reached from a node."""
    return tree.agg(F.coalesce(F.max((F.col("src") == node) & (F.col("dst") == ancestor)), F.lit(False)).alias("found"))


def has_descendant(tree: DataFrame, node, descendant) -> DataFrame:
    """One row: whether a descendant is reached from a node."""
    return has_ancestor(tree, descendant, node)


def _walks(edges: DataFrame, node, here: str, there: str) -> DataFrame:
    """Nodes that walks from one node reach, level by level, with the number of walks to each; a cycle raises ValueError."""
    step = edges.select(F.col(here).alias("__h"), F.col(there).alias("__t")).filter("__h is not null and __t is not null").distinct()
    level = checkpointed(step.filter(F.col("__h") == node).groupBy(F.col("__t").alias("node")).agg(F.count(F.lit(1)).alias("times")))
    out, depth = level.select(F.lit(0).alias("depth"), "node", "times"), 0
    while not level.isEmpty():
        if depth >= out.select("node").distinct().count():  # a walk of more steps than nodes meets one twice
            raise ValueError("a cycle of edges")
        depth += 1
        level = checkpointed(level.join(step, level.node == step["__h"]).groupBy(F.col("__t").alias("node")).agg(F.sum("times").alias("times")))
        out = out.unionByName(level.select(F.lit(depth).alias("depth"), "node", "times"))
    return out


def ancestor_walks(edges: DataFrame, node) -> DataFrame:
    """Ancestors breadth first, a node as often (``times``) as there are paths to it of a length: (depth, node, times)."""
    return _walks(edges, node, "src", "dst")


def descendant_walks(edges: DataFrame, node) -> DataFrame:
    """Descendants breadth first, a node as often (``times``) as there are paths to it of a length: (depth, node, times)."""
    return _walks(edges, node, "dst", "src")


def max_depth(tree: DataFrame) -> DataFrame:
    return tree.agg(F.max("depth").alias("max_depth"))


class GraphStore:
    """Edges under a prefix of a key-value store, each by its child and by its parent, so that both are found by a range of keys.

    Changes give a new store of the same kind; ``table`` is what to write.
    """

    #: Between the parts of a key, and the two directions.
    PART, FORWARD, BACKWARD = "·", "→", "←"

    def __init__(self, store: Store) -> None:
        self.store = store

    @classmethod
    def open(cls, spark: SparkSession, path: str, prefix: str = "graph·") -> GraphStore:
        return cls(Store.open(spark, path, prefix))

    @classmethod
    def of(cls, edges: DataFrame, prefix: str = "graph·") -> GraphStore:
        """A store of (src, dst) edges alone."""
        none = edges.select(F.lit("").alias("key"), F.lit("").alias("value")).limit(0)
        return cls(Store(none, prefix)).batch(put=edges)

    @property
    def table(self) -> DataFrame:
        return self.store.df

    def _rows(self, edges: DataFrame) -> DataFrame:
        key = lambda way, a, b: F.concat(F.lit(way + self.PART), F.col(a).cast("string"), F.lit(self.PART), F.col(b).cast("string"))
        both = F.array(key(self.FORWARD, "src", "dst"), key(self.BACKWARD, "dst", "src"))
        return edges.filter("src is not null and dst is not null").select(F.explode(both).alias("key"), F.lit("true").alias("value"))

    def batch(self, put: DataFrame | None = None, del_: DataFrame | None = None) -> GraphStore:
        """Delete edges, then add edges."""
        return GraphStore(self.store.batch(None if put is None else self._rows(put), None if del_ is None else self._rows(del_)))

    def put(self, edges: DataFrame) -> GraphStore:
        return self.batch(put=edges)

    def delete(self, edges: DataFrame) -> GraphStore:
        return self.batch(del_=edges)

    def _ends(self, way: str, node) -> DataFrame:
        head = f"{way}{self.PART}{node}{self.PART}"
        return self.store.scan(gt=head, lt=head + "\U0010ffff").select(F.substring("key", len(head) + 1, 1 << 30).alias("node"))

    def parents(self, child) -> DataFrame:
        return self._ends(self.FORWARD, child)

    def children(self, parent) -> DataFrame:
        return self._ends(self.BACKWARD, parent)

    def edges(self) -> DataFrame:
        """(src, dst) of all edges, once."""
        head = self.FORWARD + self.PART
        parts = F.split(F.substring("key", len(head) + 1, 1 << 30), self.PART)
        return self.store.scan(gt=head, lt=head + "\U0010ffff").select(parts[0].alias("src"), parts[1].alias("dst"))

    def closure(self) -> DataFrame:
        return closure(self.edges())
