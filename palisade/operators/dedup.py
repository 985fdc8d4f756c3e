"""Grouping of repeated alerts, and the incidents made of the groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.timestamps import micros
from palisade.operators.alerts import SEVERITY_ORDER, severity_rank
from palisade.operators.running import Measure, measure_groups, running

DEDUP_WINDOW_SECONDS = 300
SIMILARITY = 0.8
US = 1_000_000


def tokens(text: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9.]+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words; two empty texts are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(1.0)


def alert_groups(
    alerts: DataFrame,
    keys: Sequence[str],
    time: str,
    row_id: str,
    text: str | None = None,
    window_seconds: int = DEDUP_WINDOW_SECONDS,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """Chain each alert to the one before it with the same keys.

    A chain goes on while the gap is at most the window and, if a text column is
    given, the texts of the two neighbours share enough words. Adds
    ``group_no`` (1, 2, ... per key) and ``is_duplicate``.
    """
    base = alerts.withColumn("__us", micros(F.col(time)))
    words = [tokens(F.col(text)).alias("words")] if text else []
    cut = measure_groups(base, keys)
    before = running(
        base,
        keys,
        ["__us", row_id],
        [
            Measure(
                "__prev",
                "max",
                F.struct("__us", row_id, *words),
                inclusive=False,
            )
        ],
        cut,
    )
    starts = F.col("__prev").isNull() | (
        F.col("__us") - F.col("__prev.__us") > window_seconds * US
    )
    if text:
        starts = starts | (jaccard(tokens(F.col(text)), F.col("__prev.words")) < similarity)
    flagged = before.withColumn("__start", starts.cast("int")).drop("__prev")
    grouped = running(
        flagged,
        keys,
        ["__us", row_id],
        [Measure("group_no", "sum", F.col("__start").cast("long"))],
        cut,
    )
    return grouped.select(
        *alerts.columns, "group_no", (F.col("__start") == 0).alias("is_duplicate")
    )


def incident_links(groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(incident_id, alert_id): one row per alert, so no list grows without bound."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return groups.withColumn(
        "incident_id", F.md5(F.concat_ws("|", *parts, F.col("group_no").cast("string")))
    )


def incidents(links: DataFrame, time: str) -> DataFrame:
    """One open incident per group: size, span and highest severity."""
    names = F.array(*[F.lit(s) for s in SEVERITY_ORDER])
    return links.groupBy("incident_id").agg(
        F.count(F.lit(1)).alias("n_alerts"),
        F.get(names, F.max(severity_rank(F.col("severity"))).cast("int")).alias("severity"),
        F.lit("open").alias("status"),
        F.min(time).alias("first_alert_at"),
        F.max(time).alias("last_alert_at"),
    )
