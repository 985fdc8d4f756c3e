"""Feature queries."""

from pyspark.sql import functions as F

from contract.adapters import (
    HOST_SQL,
    NET_SQL,
    US,
    all_events,
    host_events,
    net_events,
    raw_events,
)
from contract.registry import query, table
from palisade.functions.network import is_private_ip, protocol_name
from palisade.functions.timestamps import parse_timestamp, squeeze
from palisade.operators.features import (
    behaviour_columns,
    extract_features,
    host_features,
    network_features,
)
from palisade.operators.features import flow_columns
from palisade.operators.profiles import (
    connection_profile,
    host_profile,
    protocol_distribution,
    value_entropy,
)

PRIVATE_SQL = """CASE WHEN len(string_split({0}, '.')) = 4 AND
  TRY_CAST(string_split({0}, '.')[2] AS INT) IS NOT NULL AND (
  TRY_CAST(string_split({0}, '.')[1] AS INT) IN (10, 127)
  OR (TRY_CAST(string_split({0}, '.')[1] AS INT) = 172
      AND TRY_CAST(string_split({0}, '.')[2] AS INT) BETWEEN 16 AND 31)
  OR (TRY_CAST(string_split({0}, '.')[1] AS INT) = 192
      AND TRY_CAST(string_split({0}, '.')[2] AS INT) = 168)) THEN 1 ELSE 0 END"""

SERVICES = {
    "http": "80, 8080", "https": "443, 8443", "ssh": "22", "ftp": "21", "dns": "53",
    "smtp": "25, 587", "telnet": "23", "rdp": "3389", "smb": "445, 139",
}

FLOW_SQL = f"""flow AS (SELECT *, epoch_us(ts) AS us,
  first_value(epoch_us(ts)) OVER w AS start_us, row_number() OVER w AS rn,
  sum(coalesce(packets_sent, 0)) OVER p AS past_packets,
  sum(coalesce(bytes_sent, 0)) OVER p AS past_bytes
  FROM net
  WINDOW w AS (PARTITION BY coalesce(src_ip, ''), coalesce(src_port, 0), coalesce(dst_ip, ''),
                 coalesce(dst_port, 0) ORDER BY epoch_us(ts), event_id),
         p AS (PARTITION BY coalesce(src_ip, ''), coalesce(src_port, 0), coalesce(dst_ip, ''),
                 coalesce(dst_port, 0) ORDER BY epoch_us(ts), event_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""

FLOW_COLUMNS_SQL = f"""
  CASE WHEN rn > 1 THEN round((us - start_us) / {US}.0, 6) END AS flow_duration,
  CASE WHEN rn > 1 THEN CASE WHEN us > start_us
    THEN round(past_packets / ((us - start_us) / {US}.0), 6) ELSE 0.0 END END AS packets_per_second,
  CASE WHEN rn > 1 THEN CASE WHEN us > start_us
    THEN round(past_bytes / ((us - start_us) / {US}.0), 4) ELSE 0.0 END END AS bytes_per_second"""

TCP_SQL = ", ".join(
    f"CASE WHEN upper(protocol) = 'TCP' THEN CASE WHEN contains(coalesce(tcp_flags, ''), '{x}')"
    f" THEN 1 ELSE 0 END END AS tcp_{n}"
    for n, x in [("syn", "S"), ("ack", "A"), ("fin", "F"), ("rst", "R"), ("psh", "P")]
)

NET_COLUMNS_SQL = f"""
  coalesce(bytes_sent, 0) AS bytes_sent, coalesce(bytes_received, 0) AS bytes_received,
  coalesce(packets_sent, 0) AS packets_sent, coalesce(packets_received, 0) AS packets_received,
  coalesce(bytes_sent, 0) + coalesce(bytes_received, 0) AS total_bytes,
  coalesce(packets_sent, 0) + coalesce(packets_received, 0) AS total_packets,
  round(CASE WHEN coalesce(packets_sent, 0) + coalesce(packets_received, 0) > 0
    THEN (coalesce(bytes_sent, 0) + coalesce(bytes_received, 0))
       / (coalesce(packets_sent, 0) + coalesce(packets_received, 0))::DOUBLE
    ELSE 0.0 END, 4) AS avg_packet_size,
  CASE WHEN upper(protocol) = 'TCP' THEN 1 ELSE 0 END AS protocol_tcp,
  CASE WHEN upper(protocol) = 'UDP' THEN 1 ELSE 0 END AS protocol_udp,
  CASE WHEN upper(protocol) = 'ICMP' THEN 1 ELSE 0 END AS protocol_icmp,
  CASE WHEN upper(protocol) NOT IN ('TCP', 'UDP', 'ICMP') THEN 1 ELSE 0 END AS protocol_other,
  coalesce(src_port, 0) AS src_port, coalesce(dst_port, 0) AS dst_port,
  CASE WHEN coalesce(src_port, 0) < 1024 THEN 1 ELSE 0 END AS well_known_port_src,
  CASE WHEN coalesce(dst_port, 0) < 1024 THEN 1 ELSE 0 END AS well_known_port_dst,
  CASE WHEN coalesce(src_port, 0) >= 49152 THEN 1 ELSE 0 END AS ephemeral_port_src,
  CASE WHEN coalesce(dst_port, 0) >= 49152 THEN 1 ELSE 0 END AS ephemeral_port_dst,
  {", ".join(f"CASE WHEN coalesce(dst_port, 0) IN ({p}) THEN 1 ELSE 0 END AS service_{s}" for s, p in SERVICES.items())},
  {PRIVATE_SQL.format("coalesce(src_ip, '')")} AS is_private_src,
  {PRIVATE_SQL.format("coalesce(dst_ip, '')")} AS is_private_dst"""


def _rounded(df, digits):
    return df.select(
        *[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns]
    )


NET_DIGITS = {
    "avg_packet_size": 4, "flow_duration": 6, "packets_per_second": 6, "bytes_per_second": 4,
}


@query(
    "net_features",
    f"WITH {NET_SQL}, {FLOW_SQL} SELECT event_id, {NET_COLUMNS_SQL}, {FLOW_COLUMNS_SQL}, {TCP_SQL} FROM flow",
)
def net_features(spark, sf):
    return _rounded(network_features(net_events(spark, sf)), NET_DIGITS)


@query(
    "flow_running_stats",
    f"WITH {NET_SQL}, {FLOW_SQL} SELECT event_id, {FLOW_COLUMNS_SQL} FROM flow",
)
def flow_running_stats(spark, sf):
    flows = flow_columns(
        net_events(spark, sf).select(
            "event_id", "timestamp", "src_ip", "src_port", "dst_ip", "dst_port",
            "packets_sent", "bytes_sent",
        )
    )
    return _rounded(
        flows.select("event_id", "flow_duration", "packets_per_second", "bytes_per_second"),
        NET_DIGITS,
    )


def _trailing_sql(value: str, seconds: int) -> str:
    """Sum over (t - W, t], rows of one microsecond in event order."""
    part = "PARTITION BY coalesce(hostname, 'unknown'), coalesce(username, 'unknown')"
    return (
        f"(sum({value}) OVER ({part} ORDER BY us RANGE BETWEEN {seconds * US - 1} PRECEDING"
        f" AND CURRENT ROW) - sum({value}) OVER ({part}, us) + sum({value}) OVER ({part}, us"
        f" ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
    )


BEHAVIOUR_SQL = f"""b AS (SELECT *, epoch_us(ts) AS us,
  CASE WHEN process_name <> '' THEN 1 ELSE 0 END AS spawn,
  CASE WHEN contains(lower(message), 'login') THEN 1 ELSE 0 END AS login,
  CASE WHEN command_line <> '' THEN 1 ELSE 0 END AS command FROM host),
c AS (SELECT *, CAST({_trailing_sql("spawn", 300)} AS BIGINT) AS spawns,
  CAST({_trailing_sql("login", 300)} AS BIGINT) AS logins,
  CAST({_trailing_sql("command", 300)} AS BIGINT) AS commands FROM b)"""

BEHAVIOUR_COLUMNS_SQL = """round(spawns / 300.0::DOUBLE * 60, 6) AS process_spawn_rate,
  logins AS login_frequency, round(commands / 300.0::DOUBLE * 60, 6) AS command_execution_rate"""


def _any(text: str, words: list[str]) -> str:
    return "CASE WHEN " + " OR ".join(f"contains({text}, '{w}')" for w in words) + " THEN 1 ELSE 0 END"


_P = "lower(coalesce(process_name, 'unknown'))"
_C = "coalesce(command_line, '')"
HOST_COLUMNS_SQL = f"""
  CASE WHEN coalesce(process_name, 'unknown') <> 'unknown' THEN 1 ELSE 0 END AS has_process,
  {_any(_P, ["svchost", "explorer", "system", "services", "lsass", "csrss"])} AS is_system_process,
  {_any(_P, ["bash", "sh", "cmd", "powershell", "python", "perl", "ruby"])} AS is_shell,
  CAST(length({_C}) AS INT) AS cmd_length,
  {_any(_C, ["|"])} AS cmd_has_pipe, {_any(_C, [">", "<"])} AS cmd_has_redirect,
  {_any(_C, ["&"])} AS cmd_has_background,
  {_any(f"lower({_C})", ["wget", "curl", "nc", "netcat", "powershell -enc", "base64", "eval"])} AS cmd_suspicious,
  CASE WHEN coalesce(username, 'unknown') <> 'unknown' THEN 1 ELSE 0 END AS has_username,
  CASE WHEN username IN ('root', 'administrator', '0') THEN 1 ELSE 0 END AS is_root,
  CASE WHEN coalesce(parent_process, '') = '' OR coalesce(process_name, '') = '' THEN 0
    WHEN contains(lower(parent_process), 'explorer') AND regexp_matches({_P}, 'cmd|powershell|bash') THEN 1
    WHEN regexp_matches(lower(parent_process), 'word|excel') AND regexp_matches({_P}, 'cmd|powershell') THEN 1
    WHEN regexp_matches(lower(parent_process), 'iexplore|chrome') AND regexp_matches({_P}, 'cmd|powershell') THEN 1
    ELSE 0 END AS unusual_parent_child"""

HOST_DIGITS = {"process_spawn_rate": 6, "command_execution_rate": 6}


@query(
    "host_features",
    f"WITH {HOST_SQL}, {BEHAVIOUR_SQL} SELECT event_id, {HOST_COLUMNS_SQL}, {BEHAVIOUR_COLUMNS_SQL} FROM c",
)
def host_features_query(spark, sf):
    return _rounded(host_features(host_events(spark, sf)), HOST_DIGITS)


@query(
    "host_behavior_5m",
    f"WITH {HOST_SQL}, {BEHAVIOUR_SQL} SELECT event_id, {BEHAVIOUR_COLUMNS_SQL} FROM c",
)
def host_behavior(spark, sf):
    rows = behaviour_columns(
        host_events(spark, sf).select(
            "event_id", "timestamp", "hostname", "username", "process_name", "command_line", "raw_data"
        )
    )
    return _rounded(
        rows.select("event_id", "process_spawn_rate", "login_frequency", "command_execution_rate"),
        HOST_DIGITS,
    )


@query(
    "features_by_type",
    f"""WITH {NET_SQL}, {FLOW_SQL}, {HOST_SQL}, {BEHAVIOUR_SQL},
    n AS (SELECT 'network' AS event_type, {NET_COLUMNS_SQL}, {FLOW_COLUMNS_SQL}, {TCP_SQL} FROM flow),
    h AS (SELECT 'host' AS event_type, {HOST_COLUMNS_SQL}, {BEHAVIOUR_COLUMNS_SQL} FROM c),
    u AS (SELECT * FROM n UNION ALL BY NAME SELECT * FROM h)
    SELECT event_type, count(*) AS n_events, CAST(sum(total_bytes) AS BIGINT) AS total_bytes,
      count(flow_duration) AS n_later, CAST(sum(is_private_dst) AS BIGINT) AS n_private,
      CAST(sum(tcp_syn) AS BIGINT) AS n_syn, CAST(sum(cmd_suspicious) AS BIGINT) AS n_suspicious,
      CAST(sum(login_frequency) AS BIGINT) AS logins, count(is_root) AS n_host_rows
    FROM u GROUP BY event_type""",
)
def features_by_type(spark, sf):
    return (
        extract_features(all_events(spark, sf))
        .groupBy("event_type")
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.sum("total_bytes").alias("total_bytes"),
            F.count("flow_duration").alias("n_later"),
            F.sum("is_private_dst").alias("n_private"),
            F.sum("tcp_syn").alias("n_syn"),
            F.sum("cmd_suspicious").alias("n_suspicious"),
            F.sum("login_frequency").alias("logins"),
            F.count("is_root").alias("n_host_rows"),
        )
    )


_ADDRESS = """CASE l_linenumber WHEN 1 THEN concat('10.', CAST(l_suppkey AS STRING), '.1.1')
  WHEN 2 THEN concat('172.', CAST(l_partkey % 40 AS STRING), '.3.4')
  WHEN 3 THEN concat('192.', CAST(160 + l_partkey % 20 AS STRING), '.3.4')
  WHEN 4 THEN '127.0.0.1' WHEN 5 THEN 'fe80::1' WHEN 6 THEN '10.x.1.1' ELSE NULL END"""


@query(
    "private_ip_flags",
    f"""SELECT ip, {PRIVATE_SQL.format("coalesce(ip, '')")} AS is_private, count(*) AS n
    FROM (SELECT {_ADDRESS} AS ip FROM lineitem) GROUP BY ip""",
)
def private_ip_flags(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(f"{_ADDRESS} AS ip")
    return (
        rows.withColumn("is_private", is_private_ip(F.col("ip")))
        .groupBy("ip", "is_private")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "protocol_names",
    """SELECT CASE p WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 41 THEN 'IPv6'
      WHEN 47 THEN 'GRE' WHEN 50 THEN 'ESP' WHEN 51 THEN 'AH' WHEN 58 THEN 'ICMPv6'
      ELSE CAST(p AS VARCHAR) END AS protocol, count(*) AS n
    FROM (SELECT CAST(l_quantity AS INT) AS p FROM lineitem) GROUP BY 1""",
)
def protocol_names(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        protocol_name(F.col("l_quantity").cast("int")).alias("protocol")
    )
    return rows.groupBy("protocol").agg(F.count(F.lit(1)).alias("n"))


@query(
    "timestamps_parsed",
    """SELECT event_id, CASE k % 7 WHEN 0 THEN us WHEN 1 THEN us - us % 1000000
      WHEN 2 THEN us - us % 1000000 WHEN 3 THEN us WHEN 4 THEN us - us % 1000000
      WHEN 5 THEN us - 7200000000 END AS us
    FROM (SELECT event_id, epoch_us(ts) AS us, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
          FROM events)""",
)
def timestamps_parsed(spark, sf):
    """The event time written in every accepted layout and read back."""
    stamp = F.col("ts").cast("timestamp")

    def text(layout):
        return F.date_format(stamp, layout)

    day = F.date_format(stamp, "d")
    syslog = F.concat_ws(" ", text("MMM"), F.lpad(day, 2, " "), text("HH:mm:ss"))
    written = (
        F.when(F.col("k") % 7 == 0, text("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(F.col("k") % 7 == 1, text("yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(F.col("k") % 7 == 2, text("yyyy-MM-dd HH:mm:ss"))
        .when(F.col("k") % 7 == 3, (F.unix_micros(stamp) / US).cast("decimal(20,6)").cast("string"))
        .when(F.col("k") % 7 == 4, syslog)
        .when(F.col("k") % 7 == 5, text("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'"))
        .otherwise("not a time")
    )
    rows = raw_events(spark, sf).select("event_id", squeeze(written).alias("t"))
    return rows.select(
        "event_id", F.unix_micros(parse_timestamp(F.col("t"), F.lit(2024))).alias("us")
    )


@query(
    "port_entropy",
    f"""WITH {NET_SQL}, c AS (SELECT src_ip, date_trunc('day', ts) AS d, dst_port, count(*) AS n
      FROM net WHERE dst_port IS NOT NULL GROUP BY ALL)
    SELECT src_ip, epoch_us(d) AS day_us, CAST(sum(n) AS BIGINT) AS n_events,
      round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS port_entropy
    FROM c GROUP BY src_ip, d""",
)
def port_entropy_query(spark, sf):
    rows = net_events(spark, sf).select("src_ip", "timestamp", "dst_port")
    out = value_entropy(rows, ["src_ip"], "timestamp", "day", "dst_port")
    return out.select(
        "src_ip",
        F.unix_micros("bucket").alias("day_us"),
        "n_events",
        F.round("entropy", 6).alias("port_entropy"),
    )


@query(
    "connection_profile",
    f"""WITH {NET_SQL}, n AS (SELECT *, epoch_us(ts) AS us FROM net)
    SELECT event_id, count(*) OVER w AS connection_frequency,
      count(DISTINCT dst_port) OVER w AS unique_dst_ports,
      count(DISTINCT dst_ip) OVER w AS unique_dst_ips
    FROM n WINDOW w AS (PARTITION BY src_ip ORDER BY us
      RANGE BETWEEN {2 * 86400 * US - 1} PRECEDING AND CURRENT ROW)""",
)
def connection_profile_query(spark, sf):
    rows = net_events(spark, sf).select("event_id", "timestamp", "src_ip", "dst_ip", "dst_port")
    return connection_profile(rows, 2 * 86400).select(
        "event_id", "connection_frequency", "unique_dst_ports", "unique_dst_ips"
    )


@query(
    "host_profile",
    f"""WITH {HOST_SQL}, b AS (SELECT *, epoch_us(ts) AS us, lower(coalesce(command_line, '')) AS c,
      CASE WHEN regexp_matches(lower(message), 'login.*fail|fail.*login') THEN 1 ELSE 0 END AS fl FROM host),
    d AS (SELECT *, CASE WHEN regexp_matches(c, 'sudo|runas') THEN 1 ELSE 0 END AS pe,
      CASE WHEN regexp_matches(c, '(^|[ <>])/[a-z]|[<>]') THEN 1 ELSE 0 END AS fa,
      CASE WHEN regexp_matches(c, '(http|ftp)s?://|(^| )(nc|ssh|telnet) ') THEN 1 ELSE 0 END AS nc FROM b)
    SELECT event_id, CAST({_trailing_sql("fl", 86400)} AS BIGINT) AS failed_login_count,
      CAST({_trailing_sql("pe", 86400)} AS BIGINT) AS privilege_escalation_attempts,
      round(CAST({_trailing_sql("fa", 86400)} AS DOUBLE) / 86400 * 60, 6) AS file_access_rate,
      CAST({_trailing_sql("nc", 86400)} AS BIGINT) AS network_connection_count FROM d""",
)
def host_profile_query(spark, sf):
    return host_profile(host_events(spark, sf), 86400).select(
        "event_id", "failed_login_count", "privilege_escalation_attempts",
        F.round("file_access_rate", 6).alias("file_access_rate"), "network_connection_count",
    )


@query(
    "protocol_distribution",
    f"""WITH {NET_SQL} SELECT src_ip, epoch_us(date_trunc('day', ts)) AS day_us, count(*) AS n_events,
      round(count(*) FILTER (upper(protocol) = 'TCP') / count(*), 6) AS share_tcp,
      round(count(*) FILTER (upper(protocol) = 'UDP') / count(*), 6) AS share_udp,
      round(count(*) FILTER (upper(protocol) = 'ICMP') / count(*), 6) AS share_icmp,
      round(count(*) FILTER (upper(protocol) NOT IN ('TCP', 'UDP', 'ICMP')) / count(*), 6) AS share_other
    FROM net GROUP BY src_ip, date_trunc('day', ts)""",
)
def protocol_distribution_query(spark, sf):
    out = protocol_distribution(net_events(spark, sf), "day")
    return out.select(
        "src_ip", F.unix_micros("bucket").alias("day_us"), "n_events",
        *[F.round(f"share_{p}", 6).alias(f"share_{p}") for p in ("tcp", "udp", "icmp", "other")],
    )
