"""Reading lines with their origin, and shaping rows into events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.schemas import EVENT_SCHEMA


def numbered(events: DataFrame, first_id: int = 0) -> DataFrame:
    """Give the rows of one read their ids: unique, without a shuffle, and the same
    for a retried task and for another run over the same files and split settings.

    Numbers are counted per partition from ``first_id``; give a later read the next
    free one (:func:`palisade.sources.sinks.next_event_id`). Number after a union, as
    its branches count on their own.
    """
    ids = F.monotonically_increasing_id() + F.lit(first_id).cast("long")
    return events.withColumn("event_id", ids)


def read_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(event_id, source, line) of all text files under ``path``."""
    reader = spark.read.option("recursiveFileLookup", "false")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.text(path).select(
        F.col("_metadata.file_name").alias("source"), F.col("value").alias("line")
    )
    return numbered(lines)


def to_event_schema(df: DataFrame, *extra: str) -> DataFrame:
    """All event columns in order (missing ones NULL), then the extra columns."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in EVENT_SCHEMA
        ],
        *extra,
    )


def to_process_id(text: Column) -> Column:
    """Decimal or 0x-hex process number; NULL when it is neither."""
    hexadecimal = F.conv(F.substring(text, 3, 16), 16, 10).try_cast("int")
    return F.when(F.lower(text).startswith("0x"), hexadecimal).otherwise(text.try_cast("int"))
