"""Event table to alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.operators.alerts import signature_alerts
from palisade.operators.reports import detection_statistics
from palisade.rules.catalog import DEFAULT_RULES
from palisade.rules.matching import match_events
from palisade.rules.model import Rule
from palisade.session import written
from palisade.sources.sinks import write_alerts


def detect(
    events: DataFrame,
    rules: Sequence[Rule] = DEFAULT_RULES,
    created_at: Column | None = None,
    event_type: str | None = None,
    legacy: bool = False,
) -> DataFrame:
    """Alerts of all rules on all (or one type of) events."""
    if event_type is not None:
        events = events.where(F.col("event_type") == event_type)
    stamp = F.current_timestamp() if created_at is None else created_at
    return signature_alerts(match_events(events, rules, legacy=legacy), rules, stamp)


def detect_and_store(
    events: DataFrame, path: str, rules: Sequence[Rule] = DEFAULT_RULES
) -> DataFrame:
    """Append new alerts to the table at ``path`` and report the run.

    The run's alerts are written down once, so storing and counting see the same; a run
    in which nothing fires reports zeros.
    """
    alerts = written(detect(events, rules), "run-alerts")
    write_alerts(alerts, path)
    return detection_statistics(events, alerts)
