"""Partial aggregates that reports fold, stored when rows come in.

Each run stores what its own rows add: counts, sums, the latest time, and a sketch of distinct values, by day and
kind. All of them merge (sums add up, maxima and sketches unite), so a report reads a few rows a day
instead of all events and alerts, and a run never looks at days it has no rows of. A run's partials are one folder:
repeating the run replaces them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.operators.reports import SEVERITIES, STATUSES, ioc_statistics, long_form, rule_statistics

# log2 of a sketch's registers: its relative error is about 1.04 / 2^(LG / 2), 0.6 % here, and nothing up to some hundred values.
LG = 15

PARTIAL_SCHEMA = T.StructType(
    [
        T.StructField("day", T.DateType()),
        T.StructField("section", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("bytes_sent", T.LongType()),
        T.StructField("latest", T.TimestampType()),
        T.StructField("sources", T.BinaryType()),
    ]
)


def event_partials(events: DataFrame) -> DataFrame:
    """Events, bytes, latest time and sources by day and type."""
    return events.groupBy(
        F.to_date("timestamp").alias("day"), F.lit("events").alias("section"), F.coalesce("event_type", F.lit("unknown")).alias("metric")
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("bytes_sent").alias("bytes_sent"),
        F.max("timestamp").alias("latest"),
        F.hll_sketch_agg("src_ip", F.lit(LG)).alias("sources"),
    )


def alert_partials(alerts: DataFrame) -> DataFrame:
    """Alerts in all, by status and by severity, by day of their event."""
    named = F.array(
        F.lit("total"), F.concat(F.lit("status_"), F.col("status")), F.concat(F.lit("severity_"), F.col("severity"))
    )
    rows = alerts.select(
        F.to_date(F.coalesce("event_time", "created_at")).alias("day"), F.explode(F.array_compact(named)).alias("metric"), "created_at"
    )
    return rows.groupBy("day", F.lit("alerts").alias("section"), "metric").agg(
        F.count(F.lit(1)).alias("n"),
        F.lit(None).cast("long").alias("bytes_sent"),
        F.max("created_at").alias("latest"),
        F.lit(None).cast("binary").alias("sources"),
    )


def store(path: str, run: int, *partials: DataFrame) -> None:
    """Store what a run adds."""
    reduce(DataFrame.unionByName, partials).write.mode("overwrite").parquet(f"{path}/run={run}")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARTIAL_SCHEMA).parquet(path)


def merged(partials: DataFrame, *keys: str) -> DataFrame:
    """Partials with the same keys as one."""
    return partials.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum("bytes_sent").alias("bytes_sent"),
        F.max("latest").alias("latest"),
        F.hll_union_agg("sources").alias("sources"),
    )


def daily_totals(partials: DataFrame) -> DataFrame:
    """(day, n_events, bytes_sent, latest, n_sources) over all event types."""
    days = merged(partials.where("section = 'events'"), "day")
    return days.select(
        "day", F.col("n").alias("n_events"), "bytes_sent", "latest", F.hll_sketch_estimate("sources").alias("n_sources")
    )


def dashboard(partials: DataFrame, rules: DataFrame, iocs: DataFrame) -> DataFrame:
    """The counters of :func:`palisade.operators.reports.dashboard`, from partials."""
    counts = partials.groupBy("section", "metric").agg(F.sum("n").alias("value"))
    events = counts.where("section = 'events'")
    total = events.agg(F.lit("events").alias("section"), F.lit("total").alias("metric"), F.coalesce(F.sum("value"), F.lit(0)).alias("value"))

    def of(metric: str) -> Column:
        named = (F.col("section") == "alerts") & (F.col("metric") == metric)
        return F.coalesce(F.sum(F.when(named, F.col("value"))), F.lit(0)).alias(metric)

    names = ["total", *[f"status_{s}" for s in STATUSES], *[f"severity_{s}" for s in SEVERITIES]]
    alerts = counts.agg(*[of(name) for name in names])
    parts = [events, total, long_form(alerts, "alerts"), long_form(rule_statistics(rules), "signatures"), long_form(ioc_statistics(iocs), "iocs")]
    return reduce(DataFrame.unionByName, parts)
