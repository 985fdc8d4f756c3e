"""Event and alert tables on Parquet, partitioned by day."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.operators.alerts import new_alerts_only
from palisade.schemas import ALERT_SCHEMA, EVENT_SCHEMA
from palisade.session import discard, written

ALERT_DAYS = T.StructType([*ALERT_SCHEMA.fields, T.StructField("alert_date", T.DateType())])


def write_events(events: DataFrame, path: str) -> None:
    """Append events by day and type.

    The rebalance hint lets the adaptive planner cut a heavy day into several files
    and merge the small rest.
    """
    dated = events.withColumn("event_date", F.to_date("timestamp"))
    (
        dated.hint("rebalance", F.col("event_date"), F.col("event_type"))
        .write.mode("append")
        .partitionBy("event_date", "event_type")
        .parquet(path)
    )


def read_events(
    spark: SparkSession,
    path: str,
    start: Column | None = None,
    end: Column | None = None,
    event_type: str | None = None,
) -> DataFrame:
    """Stored events of a time span [start, end) and type. The span also limits the day
    partition, so other days are never opened."""
    events = spark.read.parquet(path)
    if event_type is not None:
        events = events.where(F.col("event_type") == event_type)
    if start is not None:
        events = events.where((F.col("event_date") >= F.to_date(start)) & (F.col("timestamp") >= start))
    if end is not None:
        events = events.where((F.col("event_date") <= F.to_date(end)) & (F.col("timestamp") < end))
    return events


def stored_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """The table at ``path`` in its declared layout, None if there is nothing yet. Any
    other fault is raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def next_event_id(spark: SparkSession, path: str) -> int:
    """The first id no stored event has; 0 where nothing is stored."""
    stored = stored_table(spark, path, EVENT_SCHEMA)
    if stored is None:
        return 0
    highest = stored.agg(F.max("event_id")).first()[0]
    return 0 if highest is None else highest + 1


def write_alerts(alerts: DataFrame, path: str) -> None:
    """Append the alerts that are not stored yet, by day of their event (of creation, if that is unknown).

    An alert is always stored under the same day, so only the days of this run are looked up.
    """
    day = F.to_date(F.coalesce("event_time", "created_at"))
    run = alerts.withColumn("alert_date", day)

    def append(fresh: DataFrame) -> None:
        fresh.hint("rebalance", F.col("alert_date")).write.mode("append").partitionBy("alert_date").parquet(path)

    stored = stored_table(alerts.sparkSession, path, ALERT_DAYS)
    if stored is None:
        append(run)
        return
    # Read twice: for its days, of which there is one row each, and for its rows.
    run = written(run, "new-alerts")
    days = [r["alert_date"] for r in run.select("alert_date").distinct().collect()]
    append(new_alerts_only(run, stored.where(F.col("alert_date").isin(days))))
    discard(run)
