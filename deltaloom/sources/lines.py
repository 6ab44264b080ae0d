"""Lines of JSON and CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse(lines: DataFrame, schema: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(events, errors) of lines of JSON: one bad line is an error and the others go on. Empty lines are none."""
    fields = T.StructType.fromDDL(schema)
    fields.add("__bad", T.StringType())
    rows = lines.filter(F.trim(value) != "").select(F.col(value).alias("line"), F.from_json(value, fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("e"))
    bad = F.col("e").isNull() | F.col("e.__bad").isNotNull()
    return rows.filter(~bad).select(*[f"e.`{f.name}`" for f in fields if f.name != "__bad"]), rows.filter(bad).select("line")


def read_ndjson(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(events, errors) of files with one JSON object a line."""
    return parse(spark.read.text(path), schema)


def write_ndjson(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def _typed(rows: DataFrame, casts: dict[str, str] | None, cents: list[str]) -> DataFrame:
    for name, kind in (casts or {}).items():
        rows = rows.withColumn(name, F.col(f"`{name}`").cast(kind))
    for name in cents:
        rows = rows.withColumn(name, F.round(F.col(f"`{name}`").cast("double") * 100))
    return rows


def parse_csv(lines: DataFrame, names: list[str], casts: dict[str, str] | None = None, cents: list[str] = (), value: str = "value") -> DataFrame:
    """Lines of CSV without a header, such as a stream's, with the types that :func:`read_csv` gives."""
    fields = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = lines.select(F.from_csv(F.col(value), fields.simpleString()[7:-1].replace(":", " ")).alias("r")).select("r.*")
    return _typed(rows, casts, cents)


def read_csv(spark: SparkSession, path: str, casts: dict[str, str] | None = None, cents: list[str] = ()) -> DataFrame:
    """A CSV file with a header. Columns are text, also ``NULL``, but for ``casts``; those in ``cents`` become numbers times 100."""
    return _typed(spark.read.csv(path, header=True), casts, cents)


def counter(spark: SparkSession, end: int, start: int = 0, incr: int = 1) -> DataFrame:
    """``value`` from start to end, end included; the streaming form is the ``rate`` source."""
    return spark.range(start, end + 1, incr).withColumnRenamed("id", "value")
