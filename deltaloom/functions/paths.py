"""Nested maps: values by path, rows to maps and back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def get(tree: Column, *path: str) -> Column:
    """The value at a path; null where any step is missing."""
    for key in path:
        tree = F.try_element_at(tree, F.lit(key))
    return tree


def get_or(tree: Column, path: list[str], value: Column) -> Column:
    return F.coalesce(get(tree, *path), value)


def has(tree: Column, *path: str) -> Column:
    return get(tree, *path).isNotNull()


def keys(tree: Column, *path: str) -> Column:
    """Keys of the map at a path; none if it is missing."""
    return F.coalesce(F.map_keys(get(tree, *path)), F.array())


def assign(tree: Column, path: list[str], fn: Callable[[Column], Column]) -> Column:
    """Replace the value at a path by ``fn`` of it (of null if missing), making maps on the way."""
    key, *rest = path
    old = F.try_element_at(tree, F.lit(key))
    new = fn(old) if not rest else assign(F.coalesce(old, F.create_map()), rest, fn)
    others = F.map_filter(tree, lambda k, _: k != F.lit(key))
    return F.map_concat(others, F.create_map(F.lit(key), new))


def put(tree: Column, path: list[str], value: Column) -> Column:
    return assign(tree, path, lambda _: value)


def remove(tree: Column, *path: str) -> Column:
    """The map without the entry at a path; unchanged if a step is missing."""
    key, *rest = path
    if not rest:
        return F.map_filter(tree, lambda k, _: k != F.lit(key))
    return F.transform_values(tree, lambda k, v: F.when(k == F.lit(key), remove(v, *rest)).otherwise(v))


def clean(tree: Column, depth: int) -> Column:
    """Drop empty maps below the top of a map so many maps deep."""
    if depth < 2:
        return tree
    return F.map_filter(F.transform_values(tree, lambda _, v: clean(v, depth - 1)), lambda _, v: F.size(v) > 0)


def flat(df: DataFrame, tree: str, names: list[str], value: str) -> DataFrame:
    """One row for each leaf: its keys under ``names``, its value. Null branches are skipped."""
    kept = [c for c in df.columns if c != tree]
    for k, name in enumerate(names):
        source = tree if k == 0 else "__branch"
        df = df.select(*kept, *names[:k], F.explode(source).alias(name, "__next")).filter("__next is not null").withColumnRenamed("__next", "__branch")
    return df.withColumnRenamed("__branch", value)


def build(df: DataFrame, names: list[str], value: str, tree: str, keys_of: list[str] = ()) -> DataFrame:
    """Nest rows into one map for each of ``keys_of``: the inverse of :func:`flat`. Of rows with equal keys the largest value stays."""
    out = df.groupBy(*keys_of, *names).agg(F.max(value).alias("__v"))
    for k in range(len(names) - 1, -1, -1):
        out = out.groupBy(*keys_of, *names[:k]).agg(F.map_from_entries(F.collect_list(F.struct(F.col(names[k]).alias("key"), F.col("__v").alias("value")))).alias("__v"))
    return out.withColumnRenamed("__v", tree)
