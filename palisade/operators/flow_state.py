"""Flow statistics carried from one batch of events to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.timestamps import micros
from palisade.operators.joins import lookup_join
from palisade.operators.running import Measure, running

US = 1_000_000
KEYS = ["k_src_ip", "k_src_port", "k_dst_ip", "k_dst_port"]


def keyed(events: DataFrame) -> DataFrame:
    """Network events with their directional flow key and time in microseconds."""
    return events.select(
        "*",
        micros(F.col("timestamp")).alias("us"),
        F.coalesce("src_ip", F.lit("")).alias(KEYS[0]),
        F.coalesce("src_port", F.lit(0)).alias(KEYS[1]),
        F.coalesce("dst_ip", F.lit("")).alias(KEYS[2]),
        F.coalesce("dst_port", F.lit(0)).alias(KEYS[3]),
        F.coalesce("packets_sent", F.lit(0)).alias("v_packets"),
        F.coalesce("bytes_sent", F.lit(0)).alias("v_bytes"),
    )


def statistics(events: DataFrame, rows: DataFrame) -> DataFrame:
    """Duration and rates from ``start``, ``past_packets`` and ``past_bytes``; NULL on
    the first event of a flow."""
    duration = (F.col("us") - F.col("start")) / US

    def rate(total: str) -> Column:
        return F.when(duration > 0, F.col(total) / duration).when(duration.isNotNull(), 0.0)

    return rows.select(
        *events.columns,
        duration.alias("flow_duration"),
        rate("past_packets").alias("packets_per_second"),
        rate("past_bytes").alias("bytes_per_second"),
    )


def past_of_flow(rows: DataFrame) -> DataFrame:
    """Add start, packets and bytes of the earlier events of the flow."""
    return running(
        rows,
        KEYS,
        ["us", "event_id"],
        [
            Measure("start", "min", F.col("us"), False),
            Measure("past_packets", "sum", F.col("v_packets"), False),
            Measure("past_bytes", "sum", F.col("v_bytes"), False),
        ],
    )


def flow_batch(events: DataFrame, before: DataFrame | None) -> DataFrame:
    """Statistics of a batch, continuing the flows of ``before``."""
    rows = past_of_flow(keyed(events))
    if before is None:
        return statistics(events, rows)
    joined = lookup_join(rows, before, KEYS, how="left")
    none = F.lit(0)
    return statistics(
        events,
        joined.withColumn("start", F.least("flow_start", "start"))
        .withColumn(
            "past_packets", F.coalesce("past_packets", none) + F.coalesce("flow_packets", none)
        )
        .withColumn("past_bytes", F.coalesce("past_bytes", none) + F.coalesce("flow_bytes", none)),
    )


def flow_totals(events: DataFrame, before: DataFrame | None, since_us: int) -> DataFrame:
    """Totals of the flows of ``before`` and of further events; flows last seen before
    ``since_us`` are left out."""
    new = (
        keyed(events)
        .groupBy(*KEYS)
        .agg(
            F.min("us").alias("flow_start"),
            F.max("us").alias("flow_last"),
            F.sum("v_packets").alias("flow_packets"),
            F.sum("v_bytes").alias("flow_bytes"),
        )
    )
    merged = new
    if before is not None:
        merged = (
            before.unionByName(new)
            .groupBy(*KEYS)
            .agg(
                F.min("flow_start").alias("flow_start"),
                F.max("flow_last").alias("flow_last"),
                F.sum("flow_packets").alias("flow_packets"),
                F.sum("flow_bytes").alias("flow_bytes"),
            )
        )
    return merged.where(F.col("flow_last") >= F.lit(since_us))
