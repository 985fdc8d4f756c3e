"""Queries of rules with several steps, of thousands of rules, and of sessions."""

from pyspark.sql import functions as F

from contract.adapters import COMMANDS, DAY, HOST_SQL, NET_SQL, PROCESSES, all_events, net_events
from contract.detection import cut_always
from contract.registry import ORACLES, query
from contract.streams import process
from palisade.operators.sessions import sessions
from palisade.rules.correlation import correlation_matches
from palisade.rules.index import indexed_matches
from palisade.rules.model import Condition, Rule
from palisade.session import scratch_path
from palisade.streaming.detect_stream import start_sessions

CHAINS = [
    Rule(
        "Login, lookup, upload", "", "correlation", "", "high", "network", time_window_seconds=3 * DAY,
        confidence=0.8, signature_id=401,
        steps=(
            (Condition("dst_port", "in", values=(22, 23, 3389)),),
            (Condition("protocol", "equals", value="udp"),),
            (Condition("bytes_sent", "range", min=5_000_000),),
        ),
    ),
    Rule(
        "Tool, root, traces", "", "correlation", "", "critical", "host", time_window_seconds=2 * DAY,
        grouping_key="username", confidence=0.9, signature_id=402,
        steps=(
            (Condition("process_name", "regex", pattern="mimikatz"),),
            (Condition("command_line", "contains", value="sudo"),),
            (Condition("command_line", "regex", pattern="vssadmin|reg add"),),
            (Condition("process_name", "equals", value="rsync"), Condition("process_id", "range", min=1020)),
        ),
        reset=(Condition("raw_data.message", "contains", value="Login failed"), Condition("hostname", "equals", value="host0")),
    ),
]


def _chain_sql(source, rule, group, steps, reset, given):
    """All chains by joins of the steps, one table each; resets are counted."""
    flags = ", ".join(f"coalesce({s}, false) AS s{k}" for k, s in enumerate(steps))
    n = len(steps)
    joins = " ".join(
        f"JOIN m e{k} ON e{k}.s{k} AND e{k}.g = e0.g AND e{k}.era = e0.era AND (e{k - 1}.us, e{k - 1}.event_id) < (e{k}.us, e{k}.event_id)"
        f" AND e{k}.us - e0.us <= {rule.time_window_seconds}000000"
        for k in range(1, n)
    )
    return f"""(WITH m AS (SELECT event_id, {group} AS g, epoch_us(ts) AS us, {flags},
        sum(CASE WHEN {reset} THEN 1 ELSE 0 END) OVER (PARTITION BY {group} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS era
      FROM {source} WHERE {given})
    SELECT e{n - 1}.event_id, CAST({rule.signature_id} AS BIGINT) AS signature_id, CAST({rule.confidence} AS DOUBLE) AS confidence,
      max(e0.us) AS began_us, max(e0.g) AS grouping_value
    FROM m e0 {joins} WHERE e0.s0 GROUP BY e{n - 1}.event_id)"""


CHAIN_SQL = f"""WITH {NET_SQL}, {HOST_SQL}
{_chain_sql("net", CHAINS[0], "src_ip",
    ["dst_port IN (22, 23, 3389)", "protocol = 'udp'", "bytes_sent >= 5000000"], "false", "src_ip <> ''")}
UNION ALL
{_chain_sql("host", CHAINS[1], "username",
    ["regexp_matches(process_name, 'mimikatz', 'i')", "contains(command_line, 'sudo')",
     "regexp_matches(command_line, 'vssadmin|reg add', 'i')", "process_name = 'rsync' AND process_id >= 1020"],
    "message = 'Login failed' AND hostname = 'host0'", "username <> ''")}"""


def _chains(spark, sf):
    found = correlation_matches(all_events(spark, sf), CHAINS)
    part = lambda path: F.get_json_object("details", path)
    return found.select(
        "event_id", "signature_id", "confidence", part("$.began_us").cast("long").alias("began_us"),
        F.substring_index(part("$.grouping"), "=", -1).alias("grouping_value"),
    )


@query("correlation_alerts", CHAIN_SQL)
def correlation_alerts(spark, sf):
    """Rules of three and four steps, one with a reset."""
    return _chains(spark, sf)


@query("correlation_cut_by_range", ORACLES["correlation_alerts"])
def correlation_cut_by_range(spark, sf):
    """The same rules the way hot groups are handled."""
    with cut_always(spark):
        return _chains(spark, sf)


MANY = 20_000
TOOLS = [c for c in COMMANDS if c]
NAMES = [p for p in PROCESSES if p]


def many_rules():
    """20,000 rules of five kinds, the last without a value to file them under."""
    out = []
    for i in range(MANY):
        kind = i % 4
        if kind == 0:
            tests = (
                Condition("src_port", "equals", value=40000 + i * 100 % 25000),
                Condition("protocol", "in", values=("TCP", ("udp", "GRE", "ICMP")[i % 3])),
                Condition("bytes_sent", "range", min=i * 7 % 9_000_000),
            )
        elif kind == 1:
            tests = (
                Condition("dst_ip", "equals", value=f"203.0.113.{i % 256}"),
                Condition("bytes_sent", "range", min=i * 300, max=i * 600),
            )
        elif kind == 2:
            tests = (
                Condition("command_line", "contains", value=TOOLS[i // 4 % len(TOOLS)]),
                Condition("process_id", "range", max=1000 + i % 256),
                Condition("hostname", "equals", value=f"host{i % 20}"),
            )
        else:
            tests = (
                Condition("hostname", "in", values=(f"host{i % 20}", f"host{(i + 7) % 20}")),
                Condition("process_name", "equals", value=NAMES[i // 4 % len(NAMES)]),
                Condition("command_line", "regex", pattern="SUDO|^wget" if i % 8 == 3 else "enc|create$"),
                Condition("process_id", "equals", value=1000 + i % 256),
            )
        out.append(
            Rule(f"r{i}", "", "pattern", "", "low", "network" if kind < 2 else "host" if i % 3 else None, tests,
                 confidence=(i % 10 + 1) / 10, signature_id=1000 + i)
        )
    out.append(Rule("large", "", "pattern", "", "low", "network", (Condition("bytes_sent", "range", min=9_900_000),), signature_id=999))
    return out


def _listed(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query(
    "many_rules_alerts",
    f"""WITH {NET_SQL}, {HOST_SQL}, i AS (SELECT range AS i, range // 4 AS q FROM range({MANY})), found AS (
    SELECT event_id, i FROM i JOIN net ON i % 4 = 0 AND src_port = 40000 + i * 100 % 25000
      AND protocol IN ('TCP', ['udp', 'GRE', 'ICMP'][i % 3 + 1]) AND bytes_sent >= i * 7 % 9000000
    UNION ALL SELECT event_id, i FROM i JOIN net ON i % 4 = 1 AND dst_ip = '203.0.113.' || (i % 256)
      AND bytes_sent BETWEEN i * 300 AND i * 600
    UNION ALL SELECT event_id, i FROM i JOIN host ON i % 4 = 2 AND hostname = 'host' || (i % 20) AND process_id <= 1000 + i % 256
      AND contains(command_line, {_listed(TOOLS)}[q % {len(TOOLS)} + 1])
    UNION ALL SELECT event_id, i FROM i JOIN host ON i % 4 = 3 AND process_id = 1000 + i % 256
      AND hostname IN ('host' || (i % 20), 'host' || ((i + 7) % 20)) AND process_name = {_listed(NAMES)}[q % {len(NAMES)} + 1]
      AND regexp_matches(command_line, CASE WHEN i % 8 = 3 THEN 'SUDO|^wget' ELSE 'enc|create$' END, 'i'))
    SELECT event_id, CAST(1000 + i AS BIGINT) AS signature_id, CAST((i % 10 + 1) / 10.0 AS DOUBLE) AS confidence FROM found
    UNION ALL SELECT event_id, 999, 1.0 FROM net WHERE bytes_sent >= 9900000""",
)
def many_rules_alerts(spark, sf):
    """All events against 20,000 rules."""
    return indexed_matches(all_events(spark, sf), many_rules()).select("event_id", "signature_id", "confidence")


GAP = 12 * 3600
SESSION_SQL = f"""WITH {NET_SQL}, n AS (SELECT src_ip, epoch_us(ts) AS us, bytes_sent FROM net),
b AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY src_ip ORDER BY us) <= {GAP}000000 THEN 0 ELSE 1 END AS first FROM n),
s AS (SELECT *, sum(first) OVER (PARTITION BY src_ip ORDER BY us ROWS UNBOUNDED PRECEDING) AS number FROM b)
SELECT src_ip, min(us) AS start_us, max(us) + {GAP}000000 AS end_us, count(*) AS n_events, CAST(sum(bytes_sent) AS BIGINT) AS bytes_sent
FROM s GROUP BY src_ip, number"""


def _session_rows(found):
    return found.select(
        "src_ip", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n_events", "bytes_sent"
    )


def sums():
    return {"n_events": F.count(F.lit(1)), "bytes_sent": F.sum("bytes_sent")}


@query("session_report", SESSION_SQL)
def session_report(spark, sf):
    """Sessions of each source, which half a day of silence ends."""
    return _session_rows(sessions(net_events(spark, sf), ["src_ip"], GAP, sums()))


@query("session_report_cut_by_range", SESSION_SQL)
def session_report_cut_by_range(spark, sf):
    """The same sessions the way hot keys are handled."""
    with cut_always(spark):
        return _session_rows(sessions(net_events(spark, sf), ["src_ip"], GAP, sums()))


@query("stream_session_report", SESSION_SQL)
def stream_session_report(spark, sf):
    """The same sessions on a stream in which every third row comes ten days late and joins
    sessions that were apart until then; the watermark closes them."""
    base = scratch_path(spark, "stream-sessions")
    events = net_events(spark, sf)
    time, late = F.col("timestamp"), F.col("event_id") % 3 == 0
    cut = [F.lit(f"2024-01-{d} 00:00:00").cast("timestamp") for d in (11, 21)]
    close = events.orderBy("event_id").limit(1).withColumn("timestamp", F.lit("2024-04-01").cast("timestamp"))

    def arrivals(rows):
        yield rows.where((time < cut[0]) & ~late)
        yield rows.where(((time >= cut[0]) & (time < cut[1]) & ~late) | ((time < cut[0]) & late))
        yield rows.where(((time >= cut[1]) & ~late) | ((time >= cut[0]) & late))
        yield close.select(*rows.columns)

    process(
        spark,
        events,
        lambda stream: start_sessions(stream, ["src_ip"], GAP, sums(), f"{base}/out", f"{base}/checkpoint", 30 * DAY, once=True),
        arrivals,
    )
    return _session_rows(spark.read.parquet(f"{base}/out"))
