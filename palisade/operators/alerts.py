"""Alert rows from rule matches and anomaly scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.hashing import alert_id
from palisade.functions.scores import anomaly_severity, fusion_severity
from palisade.rules.model import Rule, rules_frame
from palisade.schemas import ALERT_SCHEMA

# Fusion weights and the texts of anomaly alerts.
SIGNATURE_WEIGHT = 0.7
ANOMALY_WEIGHT = 0.3
ANOMALY_TITLE = "ML Anomaly Detected"
ANOMALY_TEXT = "Anomalous behavior detected with score %.2f"
SEVERITY_ORDER = ["low", "medium", "high", "critical"]


def to_alert_schema(df: DataFrame, *extra: str) -> DataFrame:
    """All alert columns in order (missing ones NULL), then the extra columns."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in ALERT_SCHEMA
        ],
        *extra,
    )


def signature_alerts(matches: DataFrame, rules: Sequence[Rule], created_at: Column, *extra: str) -> DataFrame:
    """One new alert per match, with title, severity and attack ids of the rule; ``extra``
    columns of the matches are kept."""
    table = rules_frame(matches.sparkSession, rules).select(
        "signature_id",
        F.col("name").alias("title"),
        "description",
        "severity",
        "attack_tactics",
        "attack_techniques",
    )
    if "timestamp" in matches.columns:
        matches = matches.withColumn("event_time", F.col("timestamp"))
    # One rule may make most of the matches. The planner sees how large the rules are; if
    # it shuffles, it splits the matches of that rule.
    joined = matches.join(table, "signature_id").select(
        "*",
        alert_id(F.col("event_id"), F.col("title")).alias("alert_id"),
        F.lit("new").alias("status"),
        F.lit("signature").alias("detection_type"),
        F.col("confidence").alias("confidence_score"),
        F.concat(F.lit('{"details":'), F.col("details"), F.lit("}")).alias("matched_rules"),
        F.lit(False).alias("false_positive"),
        created_at.alias("created_at"),
    )
    return to_alert_schema(joined, *extra)


def mean_score(scores: Column) -> Column:
    """Mean of the non-NULL values of a map of model scores; NULL if there are none."""
    values = F.filter(F.map_values(scores), lambda x: x.isNotNull())
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(values) > 0, total / F.size(values))


def anomaly_alerts(
    scored: DataFrame, scores: Column, created_at: Column, threshold: float = 0.5
) -> DataFrame:
    """An alert for every event whose mean score exceeds the threshold."""
    named = F.map_filter(scores, lambda _, v: v.isNotNull())
    rows = (
        scored.select("event_id", named.alias("contributing_factors"))
        .withColumn("anomaly_score", mean_score(F.col("contributing_factors")))
        .where(F.col("anomaly_score") > threshold)
    )
    models = F.concat_ws(", ", F.map_keys("contributing_factors"))
    return to_alert_schema(
        rows.select(
            "*",
            alert_id(F.col("event_id"), models).alias("alert_id"),
            F.lit(ANOMALY_TITLE).alias("title"),
            F.format_string(ANOMALY_TEXT, F.col("anomaly_score")).alias("description"),
            anomaly_severity(F.col("anomaly_score")).alias("severity"),
            F.lit("new").alias("status"),
            F.lit("anomaly").alias("detection_type"),
            F.col("anomaly_score").alias("confidence_score"),
            models.alias("model_name"),
            F.lit(False).alias("false_positive"),
            created_at.alias("created_at"),
        )
    )


def fused_scores(alerts: DataFrame) -> DataFrame:
    """One row per event: weighted best signature and best anomaly score, with its band."""

    def best(kind: str) -> Column:
        hit = F.col("detection_type") == kind
        return F.coalesce(F.max(F.when(hit, F.col("confidence_score"))), F.lit(0.0))

    fused = alerts.groupBy("event_id").agg(
        best("signature").alias("signature_score"), best("anomaly").alias("anomaly_score")
    )
    score = (
        F.col("signature_score") * SIGNATURE_WEIGHT + F.col("anomaly_score") * ANOMALY_WEIGHT
    )
    return fused.withColumn("fusion_score", score).withColumn(
        "severity", fusion_severity(F.col("fusion_score"))
    )


def new_alerts_only(alerts: DataFrame, stored: DataFrame) -> DataFrame:
    """Alerts whose id is not stored yet, so a repeated run adds nothing."""
    return alerts.join(stored.select("alert_id"), "alert_id", "left_anti")


def severity_rank(severity: Column) -> Column:
    """0 (low) to 3 (critical)."""
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), severity) - 1
