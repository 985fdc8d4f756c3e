from datetime import datetime, timezone

from pyspark.sql import functions as F

from palisade.sources.common import to_event_schema


def at(seconds: float) -> datetime:
    return datetime.fromtimestamp(1_704_067_200 + seconds, tz=timezone.utc)


def events(spark, rows, event_type="network"):
    """Events from dicts; ``t`` is seconds after the start of 2024."""
    fields = {
        "event_id": "long", "t": "double", "event_type": "string", "src_ip": "string",
        "dst_ip": "string", "src_port": "int", "dst_port": "int", "protocol": "string",
        "bytes_sent": "long", "bytes_received": "long", "packets_sent": "long",
        "packets_received": "long", "hostname": "string", "username": "string",
        "process_name": "string", "command_line": "string", "parent_process": "string",
        "raw_data": "string",
    }
    data = [
        tuple({"event_id": i, "t": float(i), "event_type": event_type, **r}.get(f) for f in fields)
        for i, r in enumerate(rows)
    ]
    ddl = ", ".join(f"{n} {t}" for n, t in fields.items())
    df = spark.createDataFrame(data, ddl)
    micros = F.round((F.col("t") + 1_704_067_200) * 1_000_000).cast("long")
    return to_event_schema(df.withColumn("timestamp", F.timestamp_micros(micros)))


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def lines(spark, texts, source="f.log"):
    return spark.createDataFrame(
        [(i, source, t) for i, t in enumerate(texts)], "event_id long, source string, line string"
    )
