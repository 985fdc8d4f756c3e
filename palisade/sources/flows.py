"""Flow records to network events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.network import protocol_name
from palisade.functions.timestamps import epoch_to_timestamp
from palisade.sources.common import to_event_schema


def flow_events(records: DataFrame, now: Column | None = None) -> DataFrame:
    """Events from (event_id, timestamp [epoch s], srcaddr, dstaddr, srcport, dstport,
    protocol [number], bytes, packets); batch or stream."""
    seen = epoch_to_timestamp(F.col("timestamp"))
    raw = F.to_json(F.struct(*[c for c in records.columns if c != "event_id"]))
    return to_event_schema(
        records.select(
            "event_id",
            (seen if now is None else F.coalesce(seen, now)).alias("timestamp"),
            F.lit("network").alias("event_type"),
            F.lit("netflow").alias("source"),
            F.col("srcaddr").alias("src_ip"),
            F.col("dstaddr").alias("dst_ip"),
            F.col("srcport").alias("src_port"),
            F.col("dstport").alias("dst_port"),
            protocol_name(F.col("protocol")).alias("protocol"),
            F.coalesce("bytes", F.lit(0)).alias("bytes_sent"),
            F.coalesce("packets", F.lit(0)).alias("packets_sent"),
            raw.alias("raw_data"),
        )
    )
