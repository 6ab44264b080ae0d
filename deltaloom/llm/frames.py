"""Row-wise operators in Arrow batches, and checkpoints in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of an Arrow batch: with very long texts the bytes bind, else the rows.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Hold Arrow batches small, so that a Python worker's memory does not follow the length of texts.

    Spark reads these two settings when a plan runs, so they stay lowered in
    the session; smaller values of the caller are left as they are.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}").removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def annotate(df: DataFrame, text: str | Column, fields: str, make: Callable[[], Callable], keep: list[str] | None = None) -> DataFrame:
    """Add columns computed from a text to every row.

    ``make()`` runs in the worker and returns a function from a list of texts
    (None for null) to a dict of columns named in ``fields``. ``keep`` lists
    the input columns to carry (default: all); one whose name is also in
    ``fields`` is replaced. Rows are neither added nor dropped, so repeated
    rows, ties and an empty table need no rule of their own.
    """
    bounded_batches(df.sparkSession)
    made = T.StructType.fromDDL(fields)
    kept = [c for c in (df.columns if keep is None else keep) if c not in made.names]
    source = F.col(f"`{text}`") if isinstance(text, str) else text
    rows = df.select(*[F.col(f"`{c}`") for c in kept], source.cast("string").alias("__text"))
    schema = T.StructType([*(df.schema[c] for c in kept), *made.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            found = work(batch.column(len(kept)).to_pylist())
            columns = [batch.column(i) for i in range(len(kept))]
            for f in made.fields:
                x = found[f.name]
                columns.append(x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, _arrow(f.dataType)))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    simple = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.BooleanType: pa.bool_(), T.StringType: pa.string(), T.BinaryType: pa.binary()}
    return simple[type(kind)]


#: Below this, a table that is read may be a single split.
SMALL_BYTES = 32 << 20


def dealt(df: DataFrame) -> DataFrame:
    """Deal the rows of a small table out to all cores. Spark splits files by size, and those of one row group not at all; larger tables stay as they are read."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL_BYTES:
        return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
    return df


def _folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a local master (tests) gets a new one; a cluster's executors would not share it, so RuntimeError is raised."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    _folder(df.sparkSession)
    return df.checkpoint()


def tabled(df: DataFrame) -> DataFrame:
    """Cut the lineage by a written table in the shared folder: compressed, and read by column, where rows are many and wide."""
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
