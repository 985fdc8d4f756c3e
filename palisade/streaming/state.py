"""Stored rows of a stream by time, so that late rows can be counted where they belong.

Rows lie in folders of equal spans of event time, one file set a batch, so a repeated batch
rewrites its own files only. Progress is the latest event time seen. Rows may come up to the
stated lateness behind it; later ones, and rows dated ahead of the clock by more than the
stated skew, go to a side table and move nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.functions.timestamps import micros

US = 1_000_000
SKEW_SECONDS = 300
LATE_SECONDS = 86_400

_SPAN, _BATCH = "span", "batch"


@dataclass(frozen=True)
class Bounds:
    """What a stream accepts: how late, and how far ahead of the clock."""

    late_seconds: int = LATE_SECONDS
    skew_seconds: int = SKEW_SECONDS


@dataclass(frozen=True)
class Accepted:
    """The rows of a batch that count, the span of their times, and where progress is now.

    ``first`` is None if the batch has no such row. ``horizon`` is the time before which the
    batch's rows were late, None for the first batch; what lies before it is settled, also if
    the batch is repeated.
    """

    rows: DataFrame
    first: int | None
    last: int | None
    horizon: int | None


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def accept(batch: DataFrame, number: int, state: str, bounds: Bounds, now: Column | None = None) -> Accepted:
    """Split a batch into rows that count and rows for the side table ``state/refused``.

    The side table has the rows with ``reason``: ``late``, ``future``, or ``undated`` for a
    null time.
    """
    spark = batch.sparkSession
    progress = _read(spark, f"{state}/progress", "batch int, us long").where(F.col("batch") < number)
    reached = progress.agg(F.max("us")).first()[0]
    time = micros(F.col("timestamp"))
    clock = micros(F.current_timestamp() if now is None else now)
    reason = F.when(time.isNull(), "undated").when(time > clock + bounds.skew_seconds * US, "future")
    if reached is not None:
        reason = reason.when(time < reached - bounds.late_seconds * US, "late")
    sorted_out = batch.withColumn("reason", reason)
    refused = sorted_out.where("reason IS NOT NULL")
    refused.write.mode("overwrite").parquet(f"{state}/refused/{_BATCH}={number}")
    rows = sorted_out.where("reason IS NULL").drop("reason")
    span = rows.agg(F.min(time).alias("a"), F.max(time).alias("z")).first()
    horizon = None if reached is None else reached - bounds.late_seconds * US
    furthest = max((x for x in (reached, span["z"]) if x is not None), default=None)
    spark.createDataFrame([(furthest,)], "us long").coalesce(1).write.mode("overwrite").parquet(
        f"{state}/progress/{_BATCH}={number}"
    )
    return Accepted(rows, span["a"], span["z"], horizon)


def refused(spark: SparkSession, state: str) -> DataFrame:
    """How many rows of each reason were refused."""
    try:
        rows = spark.read.parquet(f"{state}/refused")
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], "reason string, n long")
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def keep(rows: DataFrame, number: int, state: str, span_seconds: int) -> None:
    """Store rows with a ``timestamp`` by time."""
    span = F.floor(micros(F.col("timestamp")) / (span_seconds * US)).cast("long")
    spark = rows.sparkSession
    # A repeated batch replaces what it stored, also in spans that it no longer has.
    forget(spark, state, lambda _, batch: batch == number)
    (
        rows.withColumn(_SPAN, span)
        .withColumn(_BATCH, F.lit(number))
        .write.mode("append")
        .partitionBy(_SPAN, _BATCH)
        .parquet(f"{state}/rows")
    )


def kept(
    spark: SparkSession, state: str, schema, span_seconds: int, first: int, last: int, before: int
) -> DataFrame:
    """Stored rows of earlier batches with a time in [first, last); other spans are not opened."""
    full = T.StructType([*schema.fields, T.StructField(_SPAN, T.LongType()), T.StructField(_BATCH, T.IntegerType())])
    try:
        stored = spark.read.schema(full).parquet(f"{state}/rows")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    time = micros(F.col("timestamp"))
    width = span_seconds * US
    return (
        stored.where(F.col(_SPAN).between(first // width, last // width))
        .where((F.col(_BATCH) < before) & (time >= first) & (time < last))
        .drop(_SPAN, _BATCH)
    )


def forget(spark: SparkSession, state: str, gone) -> int:
    """Delete stored (span, batch) folders for which ``gone`` holds, and empty spans."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/rows")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return 0
    count = 0
    for span in files.listStatus(path):
        name = span.getPath().getName()
        if not name.startswith(f"{_SPAN}="):
            continue
        number = int(name.split("=")[1])
        batches = list(files.listStatus(span.getPath()))
        old = [b for b in batches if gone(number, int(b.getPath().getName().split("=")[1]))]
        for b in old:
            files.delete(b.getPath(), True)
        if len(old) == len(batches):
            files.delete(span.getPath(), True)
        count += len(old)
    return count


def forget_before(spark: SparkSession, state: str, span_seconds: int, time_us: int) -> int:
    """Delete spans that end before ``time_us``."""
    return forget(spark, state, lambda span, _: (span + 1) * span_seconds * US <= time_us)
