"""Linked faceted tables: dimensions, selections, links and projections.

Everything is immutable. A :class:`Cube` is a table with dimensions, a
:class:`Model` is cubes and links, and a selection is a plain dict::

    {"orders": {"date": Range(lo, hi)}, "part": {"brand": Keys({"a", "b"})}}

Predicates stay declarative, so filters reach the scans; links are semi
joins, iterated until no table shrinks.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.functions import text as words
from deltaloom.operators.stateless import column
from deltaloom.session import checkpointed

_SAME = object()


@dataclass(frozen=True)
class Range:
    """Keys from ``lo`` to ``hi``, both included; a None bound is open, and one argument alone means equality. ``nothing``: no key at all."""

    lo: Any = None
    hi: Any = _SAME
    nulls: bool = True
    nothing: bool = False

    def current(self) -> tuple[Any, Any] | None:
        """The bounds, both included (None: open); None if no key passes."""
        return None if self.nothing else (self.lo, self.lo if self.hi is _SAME else self.hi)

    def test(self, key: Column) -> Column:
        hi = self.lo if self.hi is _SAME else self.hi
        out = F.lit(not self.nothing)
        if self.lo is not None:
            out = out & (key >= F.lit(self.lo))
        return out & (key <= F.lit(hi)) if hi is not None else out


@dataclass(frozen=True)
class Keys:
    """Discrete keys: all but ``without``, or, once ``chosen`` is a set, only those."""

    chosen: frozenset | None = None
    without: frozenset = frozenset()
    nulls: bool = True

    def change(self, put: Iterable = (), del_: Iterable = ()) -> Keys:
        """Select and deselect keys. Deselecting ends the selection of new keys by itself."""
        put, del_ = frozenset(put), frozenset(del_)
        if self.chosen is None:
            return replace(self, without=(self.without - put) | del_)
        return replace(self, chosen=(self.chosen - del_) | put)

    def current(self) -> tuple[frozenset | None, frozenset]:
        """The keys chosen (None: all) and those left out."""
        return self.chosen, self.without

    @property
    def autoexpand(self) -> bool:
        """Whether keys not seen yet will be selected."""
        return self.chosen is None and not self.without

    def test(self, key: Column) -> Column:
        if self.chosen is not None:
            return key.isin(list(self.chosen)) if self.chosen else F.lit(False)
        return ~key.isin(list(self.without)) if self.without else F.lit(True)


def all_keys(nulls: bool = True) -> Keys:
    return Keys(nulls=nulls)


def no_keys(nulls: bool = True) -> Keys:
    return Keys(chosen=frozenset(), nulls=nulls)


@dataclass(frozen=True)
class Dimension:
    """A key of rows, or for ``multiple`` an array of keys."""

    name: str
    key: Column
    multiple: bool = False
    stem: Callable[[str], str] | None = None

    def test(self, wanted: Range | Keys | None) -> Column:
        """Rows that a filter lets pass; null keys, and empty arrays, by ``nulls``."""
        if wanted is None:
            return F.lit(True)
        if not self.multiple:
            return F.when(self.key.isNull(), F.lit(wanted.nulls)).otherwise(wanted.test(self.key))
        real = F.filter(self.key, lambda k: k.isNotNull())
        return F.when(F.coalesce(F.size(real), F.lit(0)) <= 0, F.lit(wanted.nulls)).otherwise(F.exists(real, wanted.test))


@dataclass(frozen=True)
class Cube:
    """A table with a unique key, dimensions, and groups of dimensions of which any may let a row pass."""

    name: str
    df: DataFrame
    key: str
    dimensions: dict[str, Dimension] = field(default_factory=dict)
    groups: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def _with(self, d: Dimension) -> Cube:
        return replace(self, dimensions=self.dimensions | {d.name: d})

    def range_single(self, name: str, key: str | Column) -> Cube:
        return self._with(Dimension(name, column(key)))

    def range_multiple(self, name: str, keys: str | Column) -> Cube:
        return self._with(Dimension(name, column(keys), True))

    def range_multiple_text(self, name: str, text: str | Column, stem: Callable[[str], str] | None = None, stem_column: Callable[[Column], Column] | None = None) -> Cube:
        """Tokens of a text as keys. ``stem_column`` stems tokens, ``stem`` the bounds of a search."""
        return self._with(Dimension(name, words.tokens(column(text), stem_column), True, stem))

    set_single, set_multiple = range_single, range_multiple

    def or_group(self, name: str, dimensions: Iterable[str]) -> Cube:
        """A row passes if any member's filter lets it; members without a filter always do."""
        return replace(self, groups=self.groups | {name: tuple(dimensions)})

    def search(self, name: str, lo: str, hi: str | None = None) -> Range:
        """A filter of a text dimension, with stemmed bounds."""
        stem = self.dimensions[name].stem or (lambda s: s)
        return Range(stem(lo), stem(hi) if hi is not None else _SAME)

    def own(self, selection: dict[str, Any], without: str | None = None) -> Column:
        """Rows that the cube's own filters let pass, ``without`` one of them."""
        tests, grouped = [], {m for g in self.groups.values() for m in g}
        for g in self.groups.values():
            members = [m for m in g if m != without]
            if any(m in selection for m in members):
                tests.append(functools.reduce(operator.or_, [self.dimensions[m].test(selection.get(m)) for m in members]))
        tests += [self.dimensions[d].test(f) for d, f in selection.items() if d not in grouped and d != without]
        return functools.reduce(operator.and_, tests, F.lit(True))

    def filtered(self, selection: dict[str, Any], n: int | None = None) -> DataFrame:
        """Rows that pass all own filters."""
        out = self.df.filter(self.own(selection))
        return out if n is None else out.limit(n)

    def unfiltered(self, n: int | None = None) -> DataFrame:
        return self.df if n is None else self.df.limit(n)

    def hidden(self, selection: dict[str, Any]) -> DataFrame:
        """Rows that an own filter hides."""
        return self.df.filter(~self.own(selection))

    def length(self) -> DataFrame:
        return self.df.agg(F.count(F.lit(1)).alias("length"))

    def filter_of(self, selection: dict[str, Any], name: str) -> Any:
        """What a dimension filters at present: bounds of a range, chosen and left-out keys of a set; None without a filter."""
        if name not in self.dimensions:
            raise KeyError(name)
        wanted = selection.get(name)
        return wanted if wanted is None else wanted.current()

    def in_set_order(self, name: str, selection: dict[str, Any] | None = None, n: int | None = None, arrival: str | Column | None = None) -> DataFrame:
        """Rows that pass, with ``dimension_key``, key by key in the order in which keys first came by ``arrival`` (default: the cube's key), rows of a key and those without one last in that order too.

        A set is read forwards only: n <= 0 gives nothing. A multiple
        dimension gives one row for each key.
        """
        d, at = self.dimensions[name], column(arrival if arrival is not None else f"`{self.key}`")
        rows = self.df.filter(self.own(selection or {})).select((F.explode_outer(d.key) if d.multiple else d.key).alias("dimension_key"), at.alias("__at"), "*")
        came = self.df.select((F.explode_outer(d.key) if d.multiple else d.key).alias("__k"), at.alias("__first")).filter("__k is not null").groupBy("__k").agg(F.min("__first").alias("__first"))
        out = rows.join(came, F.col("dimension_key") == F.col("__k"), "left").orderBy(F.asc_nulls_last("__first"), F.col("dimension_key"), "__at", self.key).drop("__at", "__k", "__first")
        return out if n is None else out.limit(max(0, n))

    def row(self, key: Any) -> DataFrame:
        return self.df.filter(F.col(self.key) == key)

    def batch(self, put: DataFrame | None = None, del_: DataFrame | None = None) -> Cube:
        """Delete rows by key, then add rows. A key that is there already raises ValueError; unknown keys to delete are ignored."""
        df = self.df if del_ is None else self.df.join(del_.select(self.key).distinct(), self.key, "left_anti")
        if put is not None:
            new = put.select(*df.columns)
            twice = df.select(self.key).join(new.select(self.key), self.key, "left_semi").unionByName(new.groupBy(self.key).count().filter("count > 1").select(self.key))
            if not twice.isEmpty():
                raise ValueError("put with a key that is there already")
            df = df.unionByName(new)
        return replace(self, df=df)

    def keys(self, name: str, wanted: Keys | None = None) -> DataFrame:
        """Distinct keys of a dimension with ``selected``."""
        d, k = self.dimensions[name], (wanted or Keys())
        each = self.df.select((F.explode(d.key) if d.multiple else d.key).alias("key")).filter("key is not null").distinct()
        return each.withColumn("selected", k.test(F.col("key")))

    def keys_size(self, name: str) -> DataFrame:
        return self.keys(name).agg(F.count(F.lit(1)).alias("keys_size"))

    def lookup(self, name: str, key: Any) -> DataFrame:
        """Keys of rows that have a key in a dimension."""
        d = self.dimensions[name]
        return self.df.filter(F.array_contains(d.key, key) if d.multiple else d.key == F.lit(key)).select(self.key)


@dataclass(frozen=True)
class Link:
    """Rows of ``source`` refer to rows of ``target``: by ``keys`` (one, or an array), or by ``pairs``, a table of both keys (``s``, ``t``)."""

    source: str
    target: str
    keys: Column | None
    nulls: bool = True
    pairs: DataFrame | None = None

    @property
    def edge(self) -> tuple[str, str]:
        return self.source, self.target


class Model:
    """Cubes and links between them."""

    def __init__(self, cubes: Iterable[Cube], links: Iterable[Link] = ()) -> None:
        self.cubes = {c.name: c for c in cubes}
        self.links: list[Link] = []
        for x in links:
            self._add(x)

    def _add(self, x: Link) -> None:
        if any({x.source, x.target} == {y.source, y.target} for y in self.links):
            raise ValueError("these cubes are linked already")
        self.links.append(x)

    def link(self, source: str, target: str, keys: str | Column, nulls: bool = True) -> Model:
        """A model with one more link. ``keys`` is an array of the target's keys, or a single one."""
        out = Model(self.cubes.values(), self.links)
        out._add(Link(source, target, column(keys), nulls))
        return out

    def link_pairs(self, source: str, target: str, pairs: DataFrame, source_key: str, target_key: str, nulls: bool = True) -> Model:
        """A model with one more link, whose edges are rows of a table of both keys, such as the items of orders: nothing is gathered in arrays. Edges of rows that the source does not have count for nothing."""
        out = Model(self.cubes.values(), self.links)
        out._add(Link(source, target, None, nulls, pairs.select(F.col(source_key).alias("s"), F.col(target_key).alias("t"))))
        return out

    def _edges(self, x: Link) -> DataFrame:
        """Distinct (s, t) pairs of keys of a link; null keys are none."""
        cube = self.cubes[x.source]
        if x.pairs is not None:
            return x.pairs.filter("s is not null and t is not null").distinct().join(cube.df.select(F.col(cube.key).alias("s")), "s", "left_semi")
        kind = cube.df.select(x.keys.alias("k")).schema["k"].dataType.typeName()
        each = cube.df.select(F.col(cube.key).alias("s"), (F.explode(x.keys) if kind == "array" else x.keys).alias("t"))
        return each.filter("t is not null").distinct()

    def _narrow(self, x: Link, name: str, rows: DataFrame, other: DataFrame) -> DataFrame:
        """Keys of ``rows`` of one side that a link lets pass, given the visible keys of the other side.

        A row without edges passes (at the source, if nulls are shown); one
        with an edge to a visible row passes; one with an edge to a key that
        is in no table passes. Only edges and keys move, and each row's fate
        comes from one aggregate.
        """
        edges = self._edges(x)
        if name == x.source:
            target = self.cubes[x.target]
            ids = target.df.select(F.col(target.key).alias("t"))
            seen = edges.join(other.select(F.col("key").alias("t"), F.lit(True).alias("live")), "t", "left").join(ids.withColumn("known", F.lit(True)), "t", "left")
            fate = seen.groupBy(F.col("s").alias("key")).agg(F.max(F.col("live").isNotNull() | F.col("known").isNull()).alias("pass"))
            return rows.join(fate, "key", "left").filter(F.coalesce("pass", F.lit(x.nulls))).select("key")
        seen = edges.join(other.select(F.col("key").alias("s"), F.lit(True).alias("live")), "s", "left")
        fate = seen.groupBy(F.col("t").alias("key")).agg(F.max(F.col("live").isNotNull()).alias("pass"))
        return rows.join(fate, "key", "left").filter(F.coalesce("pass", F.lit(True))).select("key")

    def _tree(self) -> bool:
        """Whether the links form a forest."""
        seen: set[str] = set()
        for root in self.cubes:
            todo = [] if root in seen else [(root, None)]
            while todo:
                at, link = todo.pop()
                if at in seen:
                    return False
                seen.add(at)
                todo += [(x.target if x.source == at else x.source, x) for x in self.links if at in x.edge and x is not link]
        return True

    def _beyond(self, name: str, without: frozenset[str]) -> list[tuple[Link, str]]:
        """Links of a cube with the cube at their other end, but for some cubes."""
        out = [(x, x.target if x.source == name else x.source) for x in self.links if name in x.edge]
        return [(x, other) for x, other in out if other not in without]

    def _restricts(self, selection: dict[str, dict[str, Any]], x: Link, name: str, without: frozenset[str]) -> bool:
        """Whether anything over a link can hide rows: a filter there, or a link that hides rows without edges."""
        return not x.nulls or bool(selection.get(name)) or any(self._restricts(selection, y, other, without | {name}) for y, other in self._beyond(name, without))

    def _reduced(self, selection: dict[str, dict[str, Any]], name: str, without: frozenset[str] = frozenset()) -> DataFrame:
        """Keys of a cube that its own filters and what lies over its links let pass, but for links to some cubes. Only for forests of links.

        In a forest, what hides a row of the root comes from its branches
        alone, each narrowed from its leaves on: one pass, no way back.
        """
        cube = self.cubes[name]
        rows = cube.df.filter(cube.own(selection.get(name, {}))).select(F.col(cube.key).alias("key"))
        for x, other in self._beyond(name, without):
            if self._restricts(selection, x, other, without | {name}):
                rows = self._narrow(x, name, rows, self._reduced(selection, other, without | {name}))
        return rows

    def visible_keys(self, selection: dict[str, dict[str, Any]]) -> dict[str, DataFrame]:
        """Keys of visible rows of each cube: own filters, narrowed over all links until nothing changes.

        In a forest of links each cube is narrowed from the leaves on. A cycle
        is iterated, with counts to tell the end.
        """
        if self._tree():
            return {n: self._reduced(selection, n) for n in self.cubes}
        keys = {n: c.df.filter(c.own(selection.get(n, {}))).select(F.col(c.key).alias("key")) for n, c in self.cubes.items()}
        if not any(selection.get(n) for n in self.cubes) and all(x.nulls for x in self.links):
            return keys
        before = None
        while True:
            for x in self.links:
                for at, by in ((x.source, x.target), (x.target, x.source)):
                    keys[at] = self._narrow(x, at, keys[at], keys[by])
            keys = {n: checkpointed(k) for n, k in keys.items()}
            now = {n: k.count() for n, k in keys.items()}
            if now == before:
                return keys
            before = now

    def _link_keys(self, name: str, keys: dict[str, DataFrame]) -> DataFrame:
        """Keys of rows, hidden by own filters or not, that every link lets pass."""
        cube = self.cubes[name]
        rows = cube.df.select(F.col(cube.key).alias("key"))
        for x in self.links:
            if name in x.edge:
                rows = self._narrow(x, name, rows, keys[x.target if name == x.source else x.source])
        return rows

    def visible(self, selection: dict[str, dict[str, Any]], name: str, keys: dict[str, DataFrame] | None = None) -> DataFrame:
        """Visible rows of a cube."""
        cube = self.cubes[name]
        live = (keys or self.visible_keys(selection))[name]
        return cube.df.join(live.withColumnRenamed("key", cube.key), cube.key, "left_semi")

    def context(self, selection: dict[str, dict[str, Any]], name: str, dimension: str) -> DataFrame:
        """Rows that all filters but one dimension's let pass; links stay as that filter left them."""
        return self.all(selection, name, dimension).filter("iscontext").drop("isfiltered", "iscontext")

    def facet(self, selection: dict[str, dict[str, Any]], name: str, dimension: str) -> DataFrame:
        """Visible rows if one dimension had no filter, links included."""
        own = {k: v for k, v in selection.get(name, {}).items() if k != dimension}
        return self.visible(selection | {name: own}, name)

    def all(self, selection: dict[str, dict[str, Any]], name: str, dimension: str) -> DataFrame:
        """Every row with ``isfiltered`` (visible) and ``iscontext`` (visible but for one dimension's filter)."""
        cube, own = self.cubes[name], selection.get(name, {})
        linked = self._link_keys(name, self.visible_keys(selection)).select(F.col("key").alias(cube.key), F.lit(True).alias("__l"))
        rows = cube.df.join(linked, cube.key, "left")
        passes = F.col("__l").isNotNull()
        return rows.select(*cube.df.columns, (passes & cube.own(own)).alias("isfiltered"), (passes & cube.own(own, dimension)).alias("iscontext"))

    def ordered(self, selection: dict[str, dict[str, Any]], name: str, dimension: str, n: int | None = None, rows: DataFrame | None = None) -> DataFrame:
        """Visible rows as (``key``, columns) in order of a dimension: the first n, or for n < 0 the last, descending.

        Nulls come last, but first where a multiple dimension is read
        descending; such a dimension gives one row for each key that its
        filter selects. Ties go by the cube's key.
        """
        cube, d = self.cubes[name], self.cubes[name].dimensions[dimension]
        df = self.visible(selection, name) if rows is None else rows
        wanted = selection.get(name, {}).get(dimension)
        if d.multiple:
            out = df.select(F.explode_outer(d.key).alias("__key"), "*")
            if wanted is not None:
                out = out.filter(F.when(F.col("__key").isNull(), F.lit(wanted.nulls)).otherwise(wanted.test(F.col("__key"))))
        else:
            out = df.select(d.key.alias("__key"), "*")
        down = n is not None and n < 0
        first = (F.desc_nulls_first("__key") if d.multiple else F.desc_nulls_last("__key")) if down else F.asc_nulls_last("__key")
        out = out.orderBy(first, cube.key)
        return (out if n is None else out.limit(abs(n))).withColumnRenamed("__key", "dimension_key")

    def project(self, selection: dict[str, dict[str, Any]], chain: list[str], keys: dict[str, DataFrame] | None = None) -> DataFrame:
        """Distinct tuples of keys of visible rows along a chain of linked cubes, one column a cube."""
        if keys is not None or not self._tree():
            live = keys or self.visible_keys(selection)
        else:  # along the chain the tuples themselves are the links: only what lies beside it narrows a cube
            live = {n: self._reduced(selection, n, frozenset(chain) - {n}) for n in chain}
        out = live[chain[0]].withColumnRenamed("key", chain[0])
        for a, b in zip(chain, chain[1:], strict=False):
            x = next((y for y in self.links if {a, b} == {y.source, y.target}), None)
            if x is None:
                raise ValueError(f"no link between {a} and {b}")
            s, t = ("s", "t") if x.source == a else ("t", "s")
            edges = self._edges(x).select(F.col(s).alias(a), F.col(t).alias(b))
            out = out.join(edges, a).join(live[b].withColumnRenamed("key", b), b)
        return out.select(*chain).distinct()

    def delta(self, before: dict, after: dict, chain: list[str]) -> tuple[DataFrame, DataFrame]:
        """What a change of selection adds to and takes from a projection, or for a chain of one from the visible keys."""
        old, new = self.project(before, chain), self.project(after, chain)
        return new.exceptAll(old), old.exceptAll(new)
