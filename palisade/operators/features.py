"""Per-event features, and the ones that look at earlier events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.network import SERVICE_PORTS, is_private_ip, service_flag
from palisade.functions.text import (
    ROOT_USERS,
    SHELL_PROCESSES,
    SUSPICIOUS_COMMANDS,
    SYSTEM_PROCESSES,
    blank_to_null,
    flag,
    has_any,
    unusual_child,
)
from palisade.functions.timestamps import micros
from palisade.operators.flow_state import keyed, past_of_flow, statistics
from palisade.operators.running import Trailing, trailing_sums
from palisade.schemas import FEATURE_SCHEMA

TCP_FLAGS = {"syn": "S", "ack": "A", "fin": "F", "rst": "R", "psh": "P"}
BEHAVIOUR_WINDOW_SECONDS = 300
US = 1_000_000


def network_columns() -> dict[str, Column]:
    """Features that need only the event itself."""

    def count_of(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    total_bytes = count_of("bytes_sent") + count_of("bytes_received")
    total_packets = count_of("packets_sent") + count_of("packets_received")
    protocol = F.upper(F.coalesce(F.col("protocol"), F.lit("unknown")))
    src, dst = count_of("src_port"), count_of("dst_port")
    out = {
        name: count_of(name)
        for name in ("bytes_sent", "bytes_received", "packets_sent", "packets_received")
    }
    out |= {
        "total_bytes": total_bytes,
        "total_packets": total_packets,
        "avg_packet_size": F.when(total_packets > 0, total_bytes / total_packets).otherwise(0.0),
    }
    for name in ("tcp", "udp", "icmp"):
        out[f"protocol_{name}"] = (protocol == name.upper()).cast("int")
    out["protocol_other"] = (~protocol.isin("TCP", "UDP", "ICMP")).cast("int")
    out |= {
        "src_port": src,
        "dst_port": dst,
        "well_known_port_src": (src < 1024).cast("int"),
        "well_known_port_dst": (dst < 1024).cast("int"),
        "ephemeral_port_src": (src >= 49152).cast("int"),
        "ephemeral_port_dst": (dst >= 49152).cast("int"),
    }
    out |= {f"service_{s}": service_flag(s, dst) for s in SERVICE_PORTS}
    out["is_private_src"] = is_private_ip(F.col("src_ip"))
    out["is_private_dst"] = is_private_ip(F.col("dst_ip"))
    return out


def tcp_flag_columns() -> dict[str, Column]:
    """Flag bits of a TCP event; NULL for any other protocol."""
    tcp = F.upper(F.col("protocol")) == "TCP"
    text = F.coalesce(F.get_json_object("raw_data", "$.tcp_flags"), F.lit(""))
    return {
        f"tcp_{name}": F.when(tcp, text.contains(letter).cast("int"))
        for name, letter in TCP_FLAGS.items()
    }


def flow_columns(events: DataFrame) -> DataFrame:
    """Add duration and rates of the flow so far; NULL on a flow's first event."""
    return statistics(events, past_of_flow(keyed(events)))


def network_features(events: DataFrame) -> DataFrame:
    """event_id and the network feature columns."""
    flows = flow_columns(
        events.select(
            "event_id", "timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
            "bytes_sent", "bytes_received", "packets_sent", "packets_received", "raw_data",
        )
    )
    plain = network_columns() | {
        c: F.col(c) for c in ("flow_duration", "packets_per_second", "bytes_per_second")
    }
    columns = plain | tcp_flag_columns()
    return flows.select("event_id", *[c.alias(n) for n, c in columns.items()])


def host_columns() -> dict[str, Column]:
    """Features that need only the event itself."""
    process = F.lower(F.coalesce(F.col("process_name"), F.lit("unknown")))
    command = F.coalesce(F.col("command_line"), F.lit(""))
    parent, child = blank_to_null(F.col("parent_process")), blank_to_null(F.col("process_name"))
    return {
        "has_process": flag(F.col("process_name") != "unknown"),
        "is_system_process": has_any(process, SYSTEM_PROCESSES).cast("int"),
        "is_shell": has_any(process, SHELL_PROCESSES).cast("int"),
        "cmd_length": F.length(command),
        "cmd_has_pipe": command.contains("|").cast("int"),
        "cmd_has_redirect": (command.contains(">") | command.contains("<")).cast("int"),
        "cmd_has_background": command.contains("&").cast("int"),
        "cmd_suspicious": has_any(F.lower(command), SUSPICIOUS_COMMANDS).cast("int"),
        "has_username": flag(F.col("username") != "unknown"),
        "is_root": flag(F.col("username").isin(ROOT_USERS)),
        "unusual_parent_child": unusual_child(parent, child),
    }


def behaviour_columns(events: DataFrame) -> DataFrame:
    """Add spawn, login and command rates of (host, user) over the last minutes."""
    message = F.coalesce(F.get_json_object("raw_data", "$.message"), F.lit(""))
    keyed = events.select(
        "*",
        micros(F.col("timestamp")).alias("__us"),
        F.coalesce("hostname", F.lit("unknown")).alias("__host"),
        F.coalesce("username", F.lit("unknown")).alias("__user"),
        flag(F.col("process_name") != "").alias("__spawn"),
        flag(F.lower(message).contains("login")).alias("__login"),
        flag(F.col("command_line") != "").alias("__command"),
    )
    window = BEHAVIOUR_WINDOW_SECONDS * US
    counted = trailing_sums(
        keyed,
        ["__host", "__user"],
        "__us",
        ["event_id"],
        [
            Trailing("__spawns", F.col("__spawn"), window),
            Trailing("__logins", F.col("__login"), window),
            Trailing("__commands", F.col("__command"), window),
        ],
    )

    def per_minute(name: str) -> Column:
        return F.col(name) / float(BEHAVIOUR_WINDOW_SECONDS) * 60

    return counted.select(
        *events.columns,
        per_minute("__spawns").alias("process_spawn_rate"),
        F.col("__logins").alias("login_frequency"),
        per_minute("__commands").alias("command_execution_rate"),
    )


def host_features(events: DataFrame) -> DataFrame:
    """event_id and the host feature columns."""
    behaviour = behaviour_columns(
        events.select(
            "event_id", "timestamp", "hostname", "username", "process_name",
            "command_line", "parent_process", "raw_data",
        )
    )
    columns = host_columns() | {
        c: F.col(c)
        for c in ("process_spawn_rate", "login_frequency", "command_execution_rate")
    }
    return behaviour.select("event_id", *[c.alias(n) for n, c in columns.items()])


def extract_features(events: DataFrame) -> DataFrame:
    """All features of a mixed event table; fields of the other type are NULL."""
    net = network_features(events.where("event_type = 'network'"))
    host = host_features(events.where("event_type = 'host'"))
    return net.withColumn("event_type", F.lit("network")).unionByName(
        host.withColumn("event_type", F.lit("host")), allowMissingColumns=True
    )


def with_features(events: DataFrame) -> DataFrame:
    """Fill the ``features`` column of events, in the order of their columns.

    Each type is one branch with the ordered operators of its features; events of another
    type have none.
    """

    def packed(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
        fields = [
            columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FEATURE_SCHEMA
        ]
        return rows.select(
            *[F.struct(*fields).alias(c) if c == "features" else F.col(c) for c in events.columns]
        )

    def looked_back(*names: str) -> dict[str, Column]:
        return {n: F.col(n) for n in names}

    net = flow_columns(events.where("event_type = 'network'"))
    host = behaviour_columns(events.where("event_type = 'host'"))
    other = events.where("event_type IS NULL OR event_type NOT IN ('network', 'host')")
    flow = looked_back("flow_duration", "packets_per_second", "bytes_per_second")
    behaviour = looked_back("process_spawn_rate", "login_frequency", "command_execution_rate")
    return (
        packed(net, network_columns() | flow | tcp_flag_columns())
        .unionByName(packed(host, host_columns() | behaviour))
        .unionByName(other)
    )


def stored_features(events: DataFrame, names: list[str] | None = None) -> DataFrame:
    """event_id and the stored features (or some), as models take them."""
    return events.select("event_id", *([f"features.{n}" for n in names] if names else ["features.*"]))
