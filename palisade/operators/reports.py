"""Counts, statistics and pages over the stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IOC_TYPES = ["ip", "domain", "hash", "url"]
SEVERITIES = ["critical", "high", "medium", "low"]
STATUSES = ["new", "investigating", "resolved", "false_positive"]


def event_counts(events: DataFrame) -> DataFrame:
    """Events per type, with a total row."""
    return (
        events.rollup("event_type")
        .agg(F.count(F.lit(1)).alias("n_events"), F.grouping("event_type").alias("__all"))
        .select(
            F.when(F.col("__all") == 1, "total")
            .otherwise(F.coalesce("event_type", F.lit("unknown")))
            .alias("event_type"),
            "n_events",
        )
    )


def _matches(filters: dict[str, str | None]) -> Column:
    tests = [F.col(name) == value for name, value in filters.items() if value is not None]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def alert_count(alerts: DataFrame, severity: str | None = None, status: str | None = None):
    return alerts.where(_matches({"severity": severity, "status": status})).agg(
        F.count(F.lit(1)).alias("n_alerts")
    )


def alert_statistics(alerts: DataFrame) -> DataFrame:
    """Total and the counts by status and severity, in one pass."""
    return alerts.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(f"status_{s}") for s in STATUSES],
        *[F.count_if(F.col("severity") == s).alias(f"severity_{s}") for s in SEVERITIES],
    )


def ioc_statistics(iocs: DataFrame) -> DataFrame:
    """Total, active, and active by type (zero where a type is absent), in one pass."""
    active = F.coalesce(F.col("is_active"), F.lit(False))
    return iocs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(active).alias("active"),
        *[
            F.count_if(active & (F.col("ioc_type") == t)).alias(f"active_{t}")
            for t in IOC_TYPES
        ],
    )


def _tagged(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """Events and alerts as one narrow table, so both are counted in one aggregation."""
    return events.select(
        F.lit("event").alias("kind"), "event_type", F.lit(None).cast("string").alias("severity")
    ).unionByName(
        alerts.select(F.lit("alert").alias("kind"), "severity"), allowMissingColumns=True
    )


def _detection_counters() -> list[Column]:
    is_alert = F.col("kind") == "alert"
    return [
        F.count_if(F.col("kind") == "event").alias("events_processed"),
        F.count_if(is_alert).alias("alerts_generated"),
        *[F.count_if(is_alert & (F.col("severity") == s)).alias(s) for s in SEVERITIES],
    ]


def detection_statistics(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """Events processed, alerts generated, alerts by severity."""
    return _tagged(events, alerts).agg(*_detection_counters())


def severity_counts(alerts: DataFrame) -> DataFrame:
    """Alerts by severity; absent severities have no row."""
    return alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("n_alerts"))


def anomaly_statistics(scored: DataFrame, score: str, threshold: float = 0.5) -> DataFrame:
    """Events processed, anomalies detected, alerts generated."""
    above = F.col(score) > threshold
    return scored.agg(
        F.count(F.lit(1)).alias("events_processed"),
        F.count_if(above).alias("anomalies_detected"),
        F.count_if(above).alias("alerts_generated"),
    )


def rule_statistics(rules: DataFrame) -> DataFrame:
    return rules.agg(
        F.count_if(F.col("enabled")).alias("enabled"), F.count(F.lit(1)).alias("total")
    )


def label_distribution(labels: DataFrame, label: str) -> DataFrame:
    return labels.agg(
        F.count_if(F.col(label) == 0).alias("benign"), F.count_if(F.col(label) == 1).alias("attack")
    )


def long_form(stats: DataFrame, section: str) -> DataFrame:
    """A one-row statistics table as (section, metric, value) rows."""
    return stats.unpivot([], stats.columns, "metric", "value").select(
        F.lit(section).alias("section"), "metric", F.col("value").cast("long").alias("value")
    )


def dashboard(
    events: DataFrame, alerts: DataFrame, rules: DataFrame, iocs: DataFrame
) -> DataFrame:
    """All counters of the status report as one long table."""
    counts = event_counts(events).select(
        F.lit("events").alias("section"),
        F.col("event_type").alias("metric"),
        F.col("n_events").alias("value"),
    )
    return reduce(
        DataFrame.unionByName,
        [
            counts,
            long_form(alert_statistics(alerts), "alerts"),
            long_form(rule_statistics(rules), "signatures"),
            long_form(ioc_statistics(iocs), "iocs"),
        ],
    )


def pipeline_report(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """Ingestion and detection results of a combined run as one nested row."""
    is_event = F.col("kind") == "event"
    counters = [
        F.count_if(is_event & (F.col("event_type") == "network")).alias("network"),
        F.count_if(is_event & (F.col("event_type") == "host")).alias("host"),
        F.count_if(is_event).alias("total"),
    ]
    counted = _tagged(events, alerts).agg(*counters, *_detection_counters())
    return counted.select(
        F.struct("network", "host", "total").alias("ingestion"),
        F.struct("events_processed", "alerts_generated", *SEVERITIES).alias("detection"),
    )


def page(
    df: DataFrame,
    newest: str,
    tie: str,
    limit: int = 100,
    offset: int = 0,
    **filters: str | None,
) -> DataFrame:
    """A page, newest first, with ties broken by ``tie`` so pages never overlap."""
    return (
        df.where(_matches(filters))
        .orderBy(F.col(newest).desc(), F.col(tie).desc())
        .offset(offset)
        .limit(limit)
    )


def retained(
    df: DataFrame, time: str, now: Column, days: int = 90, day_partition: str | None = None
) -> DataFrame:
    """Rows younger than the retention period; naming the day partition of a stored
    table keeps older days from being opened."""
    oldest = now - F.expr(f"INTERVAL '{days}' DAY")
    kept = df.where(F.col(time) >= oldest)
    return kept if day_partition is None else kept.where(F.col(day_partition) >= F.to_date(oldest))
