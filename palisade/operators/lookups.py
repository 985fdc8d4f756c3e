"""Lookups of events and alerts against indicator and dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.operators.joins import lookup_join


def active_iocs(iocs: DataFrame, ioc_type: str | None = None) -> DataFrame:
    rows = iocs.where("is_active")
    return rows if ioc_type is None else rows.where(F.col("ioc_type") == ioc_type)


def ioc_hits(rows: DataFrame, row_id: str, columns: dict[str, str], iocs: DataFrame) -> DataFrame:
    """Each (row, column) whose value is an active indicator of the column's type."""
    values = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("field"),
                    F.lit(kind).alias("ioc_type"),
                    F.col(name).alias("value"),
                )
                for name, kind in columns.items()
            ]
        )
    )
    candidates = (
        rows.select(row_id, values.alias("v")).select(row_id, "v.*").where("value IS NOT NULL")
    )
    table = active_iocs(iocs).select("ioc_type", "value", "threat_type", "confidence", "severity")
    return lookup_join(candidates, table, ["ioc_type", "value"])


def with_threat_intel(alerts: DataFrame, hits: DataFrame) -> DataFrame:
    """Put the strongest indicator hit of the event into ``threat_intel`` as JSON."""
    best = hits.groupBy("event_id").agg(
        F.max(F.struct("confidence", "field", "value", "threat_type")).alias("b")
    )
    text = F.to_json(F.struct("b.field", "b.value", "b.threat_type", "b.confidence"))
    return (
        alerts.drop("threat_intel")
        .join(best, "event_id", "left")
        .withColumn("threat_intel", F.when(F.col("b").isNotNull(), text))
        .drop("b")
    )


def with_criticality(alerts: DataFrame, assets: DataFrame, on: str) -> DataFrame:
    """Criticality of the asset an alert is about; ``unknown`` if it is not listed."""
    table = assets.select(on, F.col("criticality").alias("__criticality"))
    joined = lookup_join(alerts, table, [on], how="left")
    return joined.withColumn(
        "asset_criticality", F.coalesce("__criticality", F.lit("unknown"))
    ).drop("__criticality")


def alerts_with_events(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Alerts with the columns of their event; event ids are unique, so keys are even."""
    return alerts.join(events, "event_id")


def alerts_with_comments(alerts: DataFrame, comments: DataFrame) -> DataFrame:
    """Alerts with each of their comments (NULL columns where there are none).

    All comments of one alert may be a large share of the table. An inner join can be
    cut on the side of the comments; alerts that met no comment are added back.
    """
    hit = lookup_join(comments.withColumnRenamed("created_at", "commented_at"), alerts, ["alert_id"])
    quiet = alerts.join(comments.select("alert_id").distinct(), "alert_id", "left_anti")
    return hit.unionByName(quiet, allowMissingColumns=True)


def newest_id_per_moment(events: DataFrame) -> DataFrame:
    """Largest event id of each (timestamp, event_type)."""
    return events.groupBy("timestamp", "event_type").agg(F.max("event_id").alias("event_id"))
