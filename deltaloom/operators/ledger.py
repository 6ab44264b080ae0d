"""Transactions, their changes, and measures rolled up a hierarchy of dimensions.

A transaction has ``id``, ``ts``, ``measures`` (map to double) and
``dimensions`` (array of member ids). A change is a row with ``prev`` and
``now`` structs, either of which may be null.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltaloom.operators import graph


def diff_dimensions(prev: Column, now: Column) -> dict[str, Column]:
    """``put``, ``del`` and ``same`` keys; null arrays are empty."""
    a, b = F.coalesce(prev, F.array().cast("array<string>")), F.coalesce(now, F.array().cast("array<string>"))
    return {"put": F.array_except(b, a), "del": F.array_except(a, b), "same": F.array_intersect(a, b)}


def diff_measures(prev: Column, now: Column) -> Column:
    """Map of measures to what changed: now - prev, a missing side as 0; measures with equal values on both sides drop out."""
    a, b = F.coalesce(prev, F.create_map().cast("map<string,double>")), F.coalesce(now, F.create_map().cast("map<string,double>"))
    both = F.map_zip_with(a, b, lambda _, x, y: F.when(~x.eqNullSafe(y), F.coalesce(y, F.lit(0.0)) - F.coalesce(x, F.lit(0.0))))
    return F.map_filter(both, lambda _, v: v.isNotNull())


def changes(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """Changes between two snapshots: rows that differ, as (prev, now)."""
    a = before.select(F.struct(*before.columns).alias("prev"))
    b = after.select(F.struct(*before.columns).alias("now"))
    both = a.join(b, F.col(f"prev.{key}") == F.col(f"now.{key}"), "full_outer")
    kinds = before.schema

    def plain(side: str, c: str) -> Column:  # maps are equal in whatever order their entries are
        x = F.col(f"{side}.`{c}`")
        return F.array_sort(F.map_entries(x)) if isinstance(kinds[c].dataType, T.MapType) else x

    same = functools.reduce(operator.and_, [plain("prev", c).eqNullSafe(plain("now", c)) for c in before.columns])
    return both.filter(F.col("prev").isNull() | F.col("now").isNull() | ~same)


def diff_rows(change: DataFrame) -> DataFrame:
    """(id, dimension, measure, delta) of direct dimensions: differences for those that stay, all of now for new ones, all of prev taken back for those left."""
    sides = diff_dimensions(F.col("prev.dimensions"), F.col("now.dimensions"))
    none = F.lit(None).cast("map<string,double>")
    ident = F.coalesce(F.col("now.id"), F.col("prev.id")).alias("id")
    parts = [(sides["same"], diff_measures(F.col("prev.measures"), F.col("now.measures"))), (sides["put"], diff_measures(none, F.col("now.measures"))), (sides["del"], diff_measures(F.col("prev.measures"), none))]
    rows = change.select(ident, F.explode(F.array(*[F.struct(d.alias("dims"), m.alias("m")) for d, m in parts])).alias("p"))
    return rows.select("id", F.col("p.m").alias("m"), F.explode("p.dims").alias("dimension")).select("id", "dimension", F.explode("m").alias("measure", "delta"))


def members(rows: DataFrame, tree: DataFrame) -> DataFrame:
    """(id, members): what each transaction's ``dimensions`` are tied to, themselves and their ancestors, each once.

    Only ids and members move; what is gathered is bounded by the members
    above one transaction.
    """
    reach = tree.groupBy(F.col("src").alias("__m")).agg(F.collect_set("dst").alias("__up"))
    each = rows.select("id", F.explode(F.array_distinct("dimensions")).alias("__d")).filter("__d is not null")
    ups = F.array_union(F.array("__d"), F.coalesce("__up", F.array().cast("array<string>")))
    return each.join(reach, F.col("__d") == F.col("__m"), "left").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list(ups))).alias("members"))


def spread(rows: DataFrame, tree: DataFrame) -> DataFrame:
    """(id, dimension, measure, v): a transaction's measures at each member that it is tied to or below, once."""
    each = members(rows, tree).join(rows.select("id", "measures"), "id")
    return each.select("id", "measures", F.explode("members").alias("dimension")).select("id", "dimension", F.explode("measures").alias("measure", "v"))


def change_transactions(change: DataFrame, tree: DataFrame) -> DataFrame:
    """(dimension, measure, delta) that changes make to rolled-up measures.

    An ancestor counts a transaction once, by whichever of its members: so
    what a change makes of it is all of now, if reached now, less all of
    prev, if reached then.
    """
    # both sides go through the hierarchy together, told apart by their sign in the id
    sides = [change.filter(F.col(side).isNotNull()).select(F.struct(F.lit(sign).alias("sign"), F.col(f"{side}.id").alias("id")).alias("id"), F.col(f"{side}.measures").alias("measures"), F.col(f"{side}.dimensions").alias("dimensions")) for side, sign in (("now", 1), ("prev", -1))]
    each = spread(sides[0].unionByName(sides[1]), tree)
    return each.groupBy("dimension", "measure").agg(F.sum(F.col("v") * F.col("id.sign")).alias("delta"))


def rollup(transactions: DataFrame, tree: DataFrame) -> DataFrame:
    """(dimension, measure, total, transactions): each transaction once for each member it is tied to or below."""
    return spread(transactions, tree).groupBy("dimension", "measure").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("transactions"))


def moves(rows: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, moves): members that a transaction is tied to or below by only one of two closures, as (dimension, sign): 1 by ``new`` alone, -1 by ``old`` alone."""
    sides = old.select("src", "dst", F.lit(False).alias("now")).unionByName(new.select("src", "dst", F.lit(True).alias("now")))
    reach = sides.groupBy(F.col("src").alias("__m")).agg(F.collect_set(F.when(~F.col("now"), F.col("dst"))).alias("__was"), F.collect_set(F.when(F.col("now"), F.col("dst"))).alias("__now"))
    each = rows.select("id", F.explode(F.array_distinct("dimensions")).alias("__d")).filter("__d is not null").join(reach, F.col("__d") == F.col("__m"), "left")

    def reached(ups: str) -> Column:
        return F.flatten(F.collect_list(F.array_union(F.array("__d"), F.coalesce(ups, F.array().cast("array<string>")))))

    def signed(members: Column, sign: int) -> Column:
        return F.transform(members, lambda d: F.struct(d.alias("dimension"), F.lit(sign).alias("sign")))

    both = each.groupBy("id").agg(reached("__was").alias("was"), reached("__now").alias("now"))
    return both.select("id", F.concat(signed(F.array_except("now", "was"), 1), signed(F.array_except("was", "now"), -1)).alias("moves")).filter(F.size("moves") > 0)


def change_dimensions(transactions: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(dimension, measure, delta) that a change of hierarchy edges makes.

    Only transactions tied to a member at or below a changed edge are rolled
    up, each at the members that one closure ties it to and the other does
    not: where it counts before and after, sums of doubles taken in two
    orders would leave a difference that is none. A member that a deletion
    takes must be gone from ``after`` and from the transactions' dimensions;
    :func:`drop_members` does both.
    """
    old, new = graph.closure(before), graph.closure(after)
    a, b = before.select("src", "dst").distinct(), after.select("src", "dst").distinct()
    moved = a.join(b, ["src", "dst"], "left_anti").unionByName(b.join(a, ["src", "dst"], "left_anti")).select(F.col("src").alias("member")).distinct()
    below = old.unionByName(new).join(moved, F.col("dst") == F.col("member"), "left_semi").select(F.col("src").alias("member"))
    touched = moved.unionByName(below).distinct()
    ids = transactions.select("id", F.explode("dimensions").alias("member")).join(touched, "member", "left_semi").select("id").distinct()
    each = moves(transactions.join(ids, "id", "left_semi"), old, new).join(transactions.select("id", "measures"), "id")
    rows = each.select("measures", F.explode("moves").alias("to")).select(F.col("to.dimension").alias("dimension"), F.col("to.sign").alias("sign"), F.explode("measures").alias("measure", "v"))
    return rows.groupBy("dimension", "measure").agg(F.sum(F.col("v") * F.col("sign")).alias("delta")).filter(F.abs("delta") > 1e-9)


def link_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(change, depth, src, dst): tuples that a change of hierarchy edges puts into the closure (``put``) or takes from it (``del``)."""
    old, new = graph.closure(before), graph.closure(after)
    keys = ["depth", "src", "dst"]
    put, gone = new.join(old, keys, "left_anti"), old.join(new, keys, "left_anti")
    return put.select(F.lit("put").alias("change"), *keys).unionByName(gone.select(F.lit("del").alias("change"), *keys))


def changed_members(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """(id, change): members of a dimension that a change puts, deletes or alters (``put``, ``del``, ``same``)."""
    kind = F.when(F.col("prev").isNull(), "put").when(F.col("now").isNull(), "del").otherwise("same")
    return changes(before, after, key).select(F.coalesce(F.col(f"now.{key}"), F.col(f"prev.{key}")).alias("id"), kind.alias("change"))


def drop_members(transactions: DataFrame, edges: DataFrame, gone: list[str]) -> tuple[DataFrame, DataFrame]:
    """Transactions and edges without some members."""
    left = transactions.withColumn("dimensions", F.array_except("dimensions", F.array(*map(F.lit, gone)).cast("array<string>")))
    return left, edges.filter(~F.col("src").isin(gone) & ~F.col("dst").isin(gone))
