"""Files to the event table."""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from palisade.operators.features import with_features
from palisade.operators.reports import event_counts
from palisade.sources.captures import read_captures
from palisade.sources.common import numbered, to_event_schema
from palisade.sources.logs import read_log_directory
from palisade.sources.sinks import next_event_id, write_events

log = logging.getLogger(__name__)


def read_sources(
    spark: SparkSession,
    captures: str | None = None,
    logs: str | None = None,
    now: Column | None = None,
    first_id: int = 0,
) -> DataFrame:
    """Network and host events of the given folders as one table, numbered from
    ``first_id``, with their features."""
    stamp = F.current_timestamp() if now is None else now
    parts = []
    if captures:
        parts.append(read_captures(spark, captures))
    if logs:
        parts.append(read_log_directory(spark, logs, now=stamp))
    if not parts:
        raise ValueError("no source given")
    events = reduce(DataFrame.unionByName, [to_event_schema(p) for p in parts])
    return with_features(numbered(events, first_id).withColumn("created_at", stamp))


def ingest(
    spark: SparkSession,
    path: str,
    captures: str | None = None,
    logs: str | None = None,
) -> dict[str, int]:
    """Append the events of each source to the table at ``path``.

    A source that fails counts 0 and does not stop the other; returns the number of
    events per source and the total.
    """
    sources: dict[str, Callable[[int], DataFrame]] = {}
    if captures:
        sources["network"] = lambda first: read_sources(spark, captures=captures, first_id=first)
    if logs:
        sources["host"] = lambda first: read_sources(spark, logs=logs, first_id=first)
    results = dict.fromkeys(sources, 0)
    for name, read in sources.items():
        try:
            # Counted while it is written, so sources are read once.
            seen = Observation(name)
            events = read(next_event_id(spark, path))
            counted = events.observe(seen, F.count(F.lit(1)).alias("n"))
            write_events(counted, path)
            results[name] = seen.get["n"]
        except PySparkException as error:
            log.error("%s ingestion failed: %s", name, error)
    return results | {"total": sum(results.values())}


def ingestion_report(events: DataFrame) -> DataFrame:
    """Events per type and the total."""
    return event_counts(events)
