"""Key-value and time-ordered stores as Parquet tables."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """A prefixed key-value store: (key, value as JSON). A value that replaces another is a new table."""

    def __init__(self, df: DataFrame, prefix: str = "") -> None:
        self.df, self.prefix = df, prefix

    @classmethod
    def open(cls, spark: SparkSession, path: str, prefix: str = "") -> Store:
        return cls(spark.read.parquet(path), prefix)

    def _own(self) -> DataFrame:
        n = len(self.prefix)
        return self.df.filter(F.col("key").startswith(self.prefix)).select(F.substring("key", n + 1, 1 << 30).alias("key"), "value") if n else self.df

    def get(self, key: str) -> DataFrame:
        return self._own().filter(F.col("key") == key)

    def scan(self, gt: str | None = None, lt: str | None = None, reverse: bool = False, limit: int | None = None) -> DataFrame:
        """(key, value) between bounds, both excluded, in order of key."""
        out = self._own()
        if gt is not None:
            out = out.filter(F.col("key") > gt)
        if lt is not None:
            out = out.filter(F.col("key") < lt)
        out = out.orderBy(F.desc("key") if reverse else F.asc("key"))
        return out if limit is None else out.limit(limit)

    def readall(self) -> list[tuple[str, str]]:
        """All (key, value) pairs in order of key, in the driver: only for stores that fit there, such as dimensions' names."""
        return [(r.key, r.value) for r in self.scan().collect()]

    def write(self, path: str) -> None:
        """Write the whole table, other prefixes included, to a new place."""
        self.df.write.parquet(path)

    def keys(self, **bounds: Any) -> DataFrame:
        return self.scan(**bounds).select("key")

    def values(self, **bounds: Any) -> DataFrame:
        return self.scan(**bounds).select("value")

    def batch(self, put: DataFrame | None = None, del_: DataFrame | None = None) -> Store:
        """Put (key, value) rows and delete keys: one new table. Of keys put twice the largest value stays."""
        out = self.df
        whole = lambda d: d.withColumn("key", F.concat(F.lit(self.prefix), "key"))
        gone = [whole(x.select("key")) for x in (put, del_) if x is not None]
        for x in gone:
            out = out.join(x.distinct(), "key", "left_anti")
        if put is not None:
            out = out.unionByName(whole(put.groupBy("key").agg(F.max("value").alias("value"))))
        return Store(out, self.prefix)

    def cached(self) -> Store:
        """The same, held in memory across reads."""
        return Store(self.df.cache(), self.prefix)


def series(df: DataFrame, gt: int | None = None, lt: int | None = None, ts: str = "ts", ident: str = "id", reverse: bool = False, limit: int | None = None) -> DataFrame:
    """Rows in order of time and id, between times that are both included."""
    out = df
    if gt is not None:
        out = out.filter(F.col(ts) >= gt)
    if lt is not None:
        out = out.filter(F.col(ts) <= lt)
    out = out.orderBy(F.desc(ts), F.desc(ident)) if reverse else out.orderBy(ts, ident)
    return out if limit is None else out.limit(limit)


class Series:
    """Rows with a time and an id, held once for each id. A change gives a new series."""

    def __init__(self, df: DataFrame, ts: str = "ts", ident: str = "id") -> None:
        self.df, self.ts, self.ident = df, ts, ident

    @classmethod
    def open(cls, spark: SparkSession, path: str, ts: str = "ts", ident: str = "id") -> Series:
        return cls(spark.read.parquet(path), ts, ident)

    def read(self, gt: int | None = None, lt: int | None = None, reverse: bool = False, limit: int | None = None) -> DataFrame:
        return series(self.df, gt, lt, self.ts, self.ident, reverse, limit)

    def get(self, ident: Any) -> DataFrame:
        return self.df.filter(F.col(self.ident) == ident)

    def batch(self, put: DataFrame | None = None, del_: DataFrame | None = None) -> Series:
        """Delete rows by id, then put rows; one put under an id that is there replaces it, of several the latest stays."""
        out = self.df
        for x in (del_, put):
            if x is not None:
                out = out.join(x.select(self.ident).distinct(), self.ident, "left_anti")
        if put is not None:
            last = put.groupBy(self.ident).agg(F.max_by(F.struct(*put.columns), F.struct(self.ts)).alias("r")).select("r.*")
            out = out.select(*self.df.columns).unionByName(last.select(*self.df.columns))
        return Series(out, self.ts, self.ident)

    def put(self, rows: DataFrame) -> Series:
        return self.batch(put=rows)

    def delete(self, rows: DataFrame) -> Series:
        return self.batch(del_=rows)

    def write(self, path: str) -> None:
        self.df.write.parquet(path)
