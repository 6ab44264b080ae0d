"""Session defaults and table loading."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(name: str = "deltaloom", **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; further settings by keyword with ``_`` for ``.``."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table; scans read only the columns that a query uses."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def micros(column: str) -> Column:
    """Microseconds since the epoch of a timestamp column without zone, read as UTC."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream: event_id, user_id, event_type, value, time_us."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", micros("ts").alias("time_us"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder of ``spark.checkpoint.dir``. Where that is unset, a local master gets a folder of its own; on a cluster executors would not share one, so RuntimeError is raised."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint"))
    return df.checkpoint()
