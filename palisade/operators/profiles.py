"""Window profiles of sources and hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions.text import flag
from palisade.functions.timestamps import micros
from palisade.operators.running import (
    Distinct,
    Trailing,
    measure_groups,
    trailing_distinct,
    trailing_sums,
)

US = 1_000_000


def value_entropy(
    df: DataFrame, keys: Sequence[str], time: str, unit: str, value: str
) -> DataFrame:
    """Shannon entropy (bits) of a column per key and calendar bucket."""
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.date_trunc(unit, time).alias("bucket"), value)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = F.sum("n")
    return counts.groupBy(*keys, "bucket").agg(
        total.alias("n_events"),
        (F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total).alias("entropy"),
    )


def connection_profile(events: DataFrame, window_seconds: int) -> DataFrame:
    """Connections, distinct ports and distinct targets of the source over the window.

    Rows of one microsecond see each other.
    """
    window = window_seconds * US
    base = events.withColumn("__us", micros(F.col("timestamp")))
    cut = measure_groups(base, ["src_ip"])
    out = trailing_distinct(
        base,
        ["src_ip"],
        "__us",
        ["event_id"],
        [
            Distinct("unique_dst_ports", "dst_port", window),
            Distinct("unique_dst_ips", "dst_ip", window),
        ],
        cut,
    )
    return trailing_sums(
        out,
        ["src_ip"],
        "__us",
        ["event_id"],
        [Trailing("connection_frequency", F.lit(1).cast("long"), window)],
        cut,
    ).drop("__us")


def protocol_distribution(events: DataFrame, unit: str) -> DataFrame:
    """Share of each protocol per source and calendar bucket."""
    protocol = F.upper(F.coalesce("protocol", F.lit("unknown")))
    known = ["TCP", "UDP", "ICMP"]
    shares = [F.avg((protocol == p).cast("double")).alias(f"share_{p.lower()}") for p in known]
    other = F.avg((~protocol.isin(known)).cast("double")).alias("share_other")
    return events.groupBy("src_ip", F.date_trunc(unit, "timestamp").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n_events"), *shares, other
    )


def host_profile(events: DataFrame, window_seconds: int) -> DataFrame:
    """What (host, user) did over the window: failed logins, privilege escalations,
    commands naming a file per minute, commands opening a connection."""
    window = window_seconds * US
    message = F.lower(F.coalesce(F.get_json_object("raw_data", "$.message"), F.lit("")))
    command = F.lower(F.coalesce("command_line", F.lit("")))
    flags = {
        "failed_login_count": message.rlike("login.*fail|fail.*login"),
        "privilege_escalation_attempts": command.rlike("sudo|runas"),
        "file_access_rate": command.rlike("(^|[ <>])/[a-z]|[<>]"),
        "network_connection_count": command.rlike("(http|ftp)s?://|(^| )(nc|ssh|telnet) "),
    }
    base = events.select(
        "event_id",
        micros(F.col("timestamp")).alias("us"),
        F.coalesce("hostname", F.lit("unknown")).alias("hostname"),
        F.coalesce("username", F.lit("unknown")).alias("username"),
        *[flag(c).cast("long").alias(f"is_{n}") for n, c in flags.items()],
    )
    counted = trailing_sums(
        base,
        ["hostname", "username"],
        "us",
        ["event_id"],
        [Trailing(n, F.col(f"is_{n}"), window) for n in flags],
    )
    return counted.withColumn(
        "file_access_rate", F.col("file_access_rate") / float(window_seconds) * 60
    )
