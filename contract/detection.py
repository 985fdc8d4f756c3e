"""Rule matching and alert queries."""

from pyspark.sql import functions as F

from contract.adapters import (
    ALL_RULES,
    HOST_SQL,
    IOC_RULES,
    NET_SQL,
    OPERATOR_RULES,
    TEST_RULES,
    US,
    all_events,
    created_at,
    host_events,
    net_events,
)
from contract.registry import query, table
from palisade.operators.alerts import fused_scores, signature_alerts
from palisade.operators.running import (
    GROUP_LIMIT_CONF,
    Distinct,
    Trailing,
    trailing_distinct,
    trailing_sums,
)
from palisade.functions.indicators import url_host
from palisade.functions.text import SUSPICIOUS_COMMANDS
from palisade.functions.timestamps import micros
from palisade.operators.sequences import followed_by
from palisade.plans.detect import detect, detect_and_store
from palisade.rules.catalog import DEFAULT_RULES
from palisade.rules.indicators import indicator_matches
from palisade.rules.matching import (
    ioc_rule_matches,
    match_events,
    pattern_matches,
    threshold_matches,
)
from palisade.rules.model import Condition, Rule
from palisade.schemas import ALERT_SCHEMA
from palisade.session import scratch_path

PRIV = "'^(10[.]|172[.](1[6-9]|2[0-9]|3[01])[.]|192[.]168[.])'"

# (id, table, condition, confidence, details) of every pattern rule, written out.
PATTERNS = [
    (4, "net", f"bytes_sent >= 10485760 AND regexp_matches(src_ip, {PRIV})", 0.60),
    (
        5, "net",
        f"dst_port IN (445, 139) AND regexp_matches(src_ip, {PRIV}) AND regexp_matches(dst_ip, {PRIV})",
        0.50,
    ),
    (7, "net", "dst_port = 23", 0.70),
    (
        9, "host",
        "regexp_matches(process_name, 'powershell', 'i') AND regexp_matches(command_line, '-enc(odedcommand)?', 'i')",
        0.90,
    ),
    (
        10, "host",
        "regexp_matches(command_line, '(wget|curl|Invoke-WebRequest|iwr|WebClient).*http', 'i')",
        0.75,
    ),
    (11, "host", "regexp_matches(process_name, '(nc|ncat|netcat)', 'i')", 0.85),
    (13, "host", "regexp_matches(process_name, 'mimikatz', 'i')", 0.95),
    (14, "host", "regexp_matches(command_line, '(base64|FromBase64String)', 'i')", 0.60),
    (15, "host", "regexp_matches(command_line, '(schtasks|at )/create', 'i')", 0.70),
    (16, "host", "regexp_matches(command_line, 'reg add.*(Run|RunOnce)', 'i')", 0.80),
    (17, "host", "regexp_matches(command_line, 'vssadmin.*delete.*shadows', 'i')", 0.90),
]
NAMES = {r.signature_id: r.name for r in ALL_RULES}
SEVERITY = {r.signature_id: r.severity for r in ALL_RULES}


def _names_sql(column: str, values: dict) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in values.items())
    return f"CASE {column} {arms} END"


PATTERN_SQL = "pat AS (" + " UNION ALL ".join(
    f"SELECT event_id, {i} AS signature_id, CAST({conf} AS DOUBLE) AS confidence FROM {t} WHERE {cond}"
    for i, t, cond, conf in PATTERNS
) + ")"


def trailing_count_sql(group: str, seconds: int, ties: str = "event_id") -> str:
    """Exact arrival count over (t - W, t]."""
    part = f"PARTITION BY {group}"
    return (
        f"(count(*) OVER ({part} ORDER BY us RANGE BETWEEN {seconds * US - 1} PRECEDING AND CURRENT ROW)"
        f" - count(*) OVER ({part}, us) + row_number() OVER ({part}, us ORDER BY {ties}))"
    )


# (id, table, group, condition, threshold, seconds, confidence)
def _threshold_specs(rules):
    out = []
    conditions = {
        2: "dst_port = 22", 3: "dst_port = 3389", 6: "dst_port = 53", 8: "protocol = 'ICMP'",
        12: "contains(command_line, 'sudo')",
    }
    for r in rules:
        if r.rule_type == "threshold":
            t = "net" if r.event_type == "network" else "host"
            out.append(
                (r.signature_id, t, r.grouping_key, conditions.get(r.signature_id), r.threshold,
                 r.time_window_seconds, r.confidence)
            )
    return out


def _threshold_sql(rules, us: str = "epoch_us(ts)") -> str:
    parts = []
    for i, t, group, condition, threshold, seconds, conf in _threshold_specs(rules):
        where = f"{group} IS NOT NULL" + (f" AND {condition}" if condition else "")
        if condition is None:
            n = (
                f"count(DISTINCT nullif(dst_port, 0)) OVER (PARTITION BY {group} ORDER BY us"
                f" RANGE BETWEEN {seconds * US - 1} PRECEDING AND CURRENT ROW)"
            )
        else:
            n = trailing_count_sql(group, seconds)
        parts.append(
            f"SELECT event_id, {i} AS signature_id, least(1.0::DOUBLE, {conf}::DOUBLE * (n / {threshold}.0::DOUBLE)) AS confidence,"
            f" n, {threshold} AS threshold, {seconds} AS secs, '{group}=' || grp AS grouping_text"
            f" FROM (SELECT event_id, {group} AS grp, {n} AS n FROM (SELECT *, {us} AS us FROM {t}) WHERE {where})"
            f" WHERE n >= {threshold}"
        )
    return "thr AS (" + " UNION ALL ".join(parts) + ")"


THRESHOLD_SQL = _threshold_sql(TEST_RULES)
DETAILS_SQL = (
    "'{\"count\":' || n || ',\"threshold\":' || threshold || ',\"time_window\":' || secs ||"
    " ',\"grouping\":\"' || grouping_text || '\"}'"
)


def _ioc_sql() -> str:
    bad = ", ".join(f"'{v}'" for v in IOC_RULES[0].ioc_values)
    tools = IOC_RULES[1].ioc_values
    listed = ", ".join(f"'{v}'" for v in tools)
    last = "CASE " + " ".join(
        f"WHEN contains(command_line, '{v}') THEN '{v}'" for v in reversed(tools)
    ) + " END"
    return f"""ioc AS (
      SELECT event_id, 101 AS signature_id, CAST(0.9 AS DOUBLE) AS confidence,
        '{{' || concat_ws(',', CASE WHEN src_ip IN ({bad}) THEN '"src_ip":"' || src_ip || '"' END,
          CASE WHEN dst_ip IN ({bad}) THEN '"dst_ip":"' || dst_ip || '"' END) || '}}' AS details
      FROM net WHERE src_ip IN ({bad}) OR dst_ip IN ({bad})
      UNION ALL
      SELECT event_id, 102, CAST(0.95 AS DOUBLE),
        '{{' || concat_ws(',', CASE WHEN process_name IN ({listed}) THEN '"process_name":"' || process_name || '"' END,
          CASE WHEN {last} IS NOT NULL THEN '"command_line":"' || {last} || '"' END) || '}}'
      FROM host WHERE process_name IN ({listed}) OR {last} IS NOT NULL
      UNION ALL
      SELECT event_id, 102, CAST(0.95 AS DOUBLE),
        '{{' || concat_ws(',', CASE WHEN src_ip IN ({listed}) THEN '"src_ip":"' || src_ip || '"' END,
          CASE WHEN dst_ip IN ({listed}) THEN '"dst_ip":"' || dst_ip || '"' END) || '}}'
      FROM net WHERE src_ip IN ({listed}) OR dst_ip IN ({listed}))"""


IOC_SQL = _ioc_sql()
ALERT_SQL = f"""WITH {NET_SQL}, {HOST_SQL}, {PATTERN_SQL}, {THRESHOLD_SQL}, {IOC_SQL},
m AS (SELECT event_id, signature_id, confidence FROM pat
  UNION ALL SELECT event_id, signature_id, confidence FROM thr
  UNION ALL SELECT event_id, signature_id, confidence FROM ioc),
alerts AS (SELECT *, {_names_sql("signature_id", NAMES)} AS title,
  {_names_sql("signature_id", SEVERITY)} AS severity,
  md5(event_id || ':' || {_names_sql("signature_id", NAMES)}) AS alert_id FROM m)"""


def rule_alerts(spark, sf):
    """Alerts of all rules on all events."""
    return detect(all_events(spark, sf), ALL_RULES, created_at())


@query(
    "alert_union_all_rules",
    ALERT_SQL + " SELECT severity, title, count(*) AS n_alerts, round(avg(confidence), 6) AS mean_confidence"
    " FROM alerts GROUP BY severity, title",
)
def alert_union_all_rules(spark, sf):
    return (
        rule_alerts(spark, sf)
        .groupBy("severity", "title")
        .agg(
            F.count(F.lit(1)).alias("n_alerts"),
            F.round(F.avg("confidence_score"), 6).alias("mean_confidence"),
        )
    )


@query(
    "pattern_alerts",
    f"""WITH {NET_SQL}, {HOST_SQL}, {PATTERN_SQL}
    SELECT md5(event_id || ':' || {_names_sql("signature_id", NAMES)}) AS alert_id, event_id,
      {_names_sql("signature_id", NAMES)} AS title, {_names_sql("signature_id", SEVERITY)} AS severity,
      'new' AS status, 'signature' AS detection_type, confidence AS confidence_score,
      CAST(signature_id AS BIGINT) AS signature_id FROM pat""",
)
def pattern_alerts(spark, sf):
    matches = pattern_matches(all_events(spark, sf), DEFAULT_RULES)
    return signature_alerts(matches, DEFAULT_RULES, created_at()).select(
        "alert_id", "event_id", "title", "severity", "status", "detection_type",
        "confidence_score", "signature_id",
    )


def _pattern_details_sql() -> str:
    priv = PRIV.strip("'").replace("[.]", "\\\\.")
    texts = {
        4: '{"bytes_sent":"in range [10485760, None]","src_ip":"matches pattern ' + priv + '"}',
        5: '{"dst_port":"in [445, 139]","src_ip":"matches pattern ' + priv
        + '","dst_ip":"matches pattern ' + priv + '"}',
        7: '{"dst_port":"equals 23"}',
        9: '{"process_name":"matches pattern powershell","command_line":"matches pattern -enc(odedcommand)?"}',
        10: '{"command_line":"matches pattern (wget|curl|Invoke-WebRequest|iwr|WebClient).*http"}',
        11: '{"process_name":"matches pattern (nc|ncat|netcat)"}',
        13: '{"process_name":"matches pattern mimikatz"}',
        14: '{"command_line":"matches pattern (base64|FromBase64String)"}',
        15: '{"command_line":"matches pattern (schtasks|at )/create"}',
        16: '{"command_line":"matches pattern reg add.*(Run|RunOnce)"}',
        17: '{"command_line":"matches pattern vssadmin.*delete.*shadows"}',
    }
    return _names_sql("signature_id", texts)


@query(
    "pattern_match_details",
    f"""WITH {NET_SQL}, {HOST_SQL}, {PATTERN_SQL}
    SELECT event_id, CAST(signature_id AS BIGINT) AS signature_id, {_pattern_details_sql()} AS details FROM pat""",
)
def pattern_match_details(spark, sf):
    return pattern_matches(all_events(spark, sf), DEFAULT_RULES).select(
        "event_id", "signature_id", "details"
    )


@query(
    "pattern_operators",
    f"""WITH {NET_SQL}, {HOST_SQL}
    SELECT event_id, CAST(201 AS BIGINT) AS signature_id FROM net WHERE protocol = 'udp'
    UNION ALL SELECT event_id, 202 FROM net WHERE dst_port IN (80, 443)
    UNION ALL SELECT event_id, 203 FROM net WHERE bytes_sent BETWEEN 1000000 AND 5000000
    UNION ALL SELECT event_id, 204 FROM host WHERE contains(command_line, 'Delete')
    UNION ALL SELECT event_id, 205 FROM host WHERE regexp_matches(command_line, '^vss.*(all|SHADOWS)$', 'i')
    UNION ALL SELECT event_id, 206 FROM host WHERE contains(message, 'failed')
    UNION ALL SELECT event_id, 207 FROM host WHERE hostname = 'host3' AND process_id <= 1050""",
)
def pattern_operators(spark, sf):
    """Each condition type on its own, a disabled rule, an empty one, an unknown field."""
    return pattern_matches(all_events(spark, sf), OPERATOR_RULES).select("event_id", "signature_id")


SUSPICIOUS = " OR ".join(f"contains(lower(coalesce(command_line, '')), '{w.lower()}')" for w in SUSPICIOUS_COMMANDS)


@query(
    "pattern_feature_path",
    f"""WITH {NET_SQL}, {HOST_SQL}
    SELECT event_id, CAST(401 AS BIGINT) AS signature_id FROM net WHERE upper(coalesce(protocol, 'unknown')) = 'TCP'
    UNION ALL SELECT event_id, 402 FROM host WHERE {SUSPICIOUS}""",
)
def pattern_feature_path(spark, sf):
    """Rules on stored features."""
    rules = [
        Rule(name, "", "pattern", "", "low", None, (Condition(f"features.{name}", "equals", value=1),), signature_id=i)
        for i, name in ((401, "protocol_tcp"), (402, "cmd_suspicious"))
    ]
    return pattern_matches(all_events(spark, sf), rules).select("event_id", "signature_id")


@query(
    "ioc_ip_alerts",
    f"WITH {NET_SQL}, {HOST_SQL}, {IOC_SQL} SELECT event_id, details FROM ioc WHERE signature_id = 101",
)
def ioc_ip_alerts(spark, sf):
    return ioc_rule_matches(all_events(spark, sf), IOC_RULES[:1]).select("event_id", "details")


@query(
    "ioc_command_alerts",
    f"WITH {NET_SQL}, {HOST_SQL}, {IOC_SQL} SELECT event_id, details FROM ioc WHERE signature_id = 102",
)
def ioc_command_alerts(spark, sf):
    return ioc_rule_matches(all_events(spark, sf), IOC_RULES[1:]).select("event_id", "details")


@query(
    "detect_store_report",
    f"""WITH {NET_SQL}, {HOST_SQL}, {PATTERN_SQL}, n AS (SELECT (SELECT count(*) FROM net) + (SELECT count(*) FROM host) AS events,
      (SELECT count(*) FROM pat) AS alerts)
    SELECT 1 AS run, events AS events_processed, alerts AS alerts_generated, alerts AS n_stored FROM n
    UNION ALL SELECT 2, count(*), 0, (SELECT alerts FROM n) FROM net WHERE dst_port IS NULL AND bytes_sent < 10485760
    UNION ALL SELECT 3, events, alerts, alerts FROM n""",
)
def detect_store_report(spark, sf):
    """Three runs into one table: all events, some on which nothing fires, and all again."""
    path = scratch_path(spark, "alerts")
    patterns = [r for r in DEFAULT_RULES if r.rule_type == "pattern"]
    events = all_events(spark, sf)
    quiet = events.where("event_type = 'network' AND dst_port IS NULL AND bytes_sent < 10485760")
    out = []
    for number, part in enumerate((events, quiet, events), 1):
        report = detect_and_store(part, path, patterns).select("events_processed", "alerts_generated")
        row = report.first()
        out.append((number, *row, spark.read.schema(ALERT_SCHEMA).parquet(path).count()))
    return spark.createDataFrame(out, "run int, events_processed long, alerts_generated long, n_stored long")


THRESHOLD_OUT = f"SELECT event_id, CAST(signature_id AS BIGINT) AS signature_id, round(confidence, 9) AS confidence, {DETAILS_SQL} AS details FROM thr"


def _threshold_rows(matches):
    return matches.select(
        "event_id", "signature_id", F.round("confidence", 9).alias("confidence"), "details"
    )


@query("threshold_alerts", f"WITH {NET_SQL}, {HOST_SQL}, {THRESHOLD_SQL} {THRESHOLD_OUT}")
def threshold_alerts(spark, sf):
    return _threshold_rows(threshold_matches(all_events(spark, sf), TEST_RULES))


# Time runs so much faster that the month of events passes in about two minutes, and the
# windows of the shipped rules, which are seconds, hold enough of them.
FASTER = 20_000


@query(
    "threshold_alerts_shipped_windows",
    f"WITH {NET_SQL}, {HOST_SQL}, {_threshold_sql(DEFAULT_RULES, f'epoch_us(ts) // {FASTER}')} {THRESHOLD_OUT}",
)
def threshold_alerts_shipped_windows(spark, sf):
    """The rules as shipped, on the same events in quick succession."""
    quick = F.timestamp_micros(F.floor(F.unix_micros("timestamp") / F.lit(FASTER)).cast("long"))
    events = all_events(spark, sf).withColumn("timestamp", quick)
    return _threshold_rows(threshold_matches(events, DEFAULT_RULES))


# A long list of indicators: the hosts of the pages, an address for each order, all of one beginning, and text that
# command lines hold. What stands last in it has the largest position, of the same position the largest value.
LONG_LIST_SQL = """listed AS (SELECT DISTINCT lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS v, 0 AS i FROM pages
  UNION SELECT 'http://198.51.100.' || (o_orderkey % 9) || '/' || substr('abcdef', 1 + CAST(o_orderkey % 6 AS INT), 1)
    || CASE WHEN o_orderkey % 100 = 6 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END, 1 FROM orders
  UNION ALL SELECT v, i FROM (VALUES
    ('example.org', 2), ('.sh', 3), ('198.51.100.7', 4), ('sudo', 5), ('vssadmin delete', 6), ('no such text', 7), ('su', 8)) t(v, i))"""
EXTRA_INDICATORS = ("example.org", ".sh", "198.51.100.7", "sudo", "vssadmin delete", "no such text", "su")


@query(
    "ioc_long_list_alerts",
    f"""WITH {HOST_SQL}, {LONG_LIST_SQL}
    SELECT event_id, arg_max(v, (i, v)) AS found FROM host JOIN listed ON v <> '' AND contains(command_line, v) GROUP BY event_id""",
)
def ioc_long_list_alerts(spark, sf):
    """Command lines against a long list, which is a table; the value that stands last in it is reported."""
    hosts = table(spark, sf, "pages").select(url_host(F.col("url")).alias("value"), F.lit(0).cast("long").alias("position"))
    key = F.col("o_orderkey")
    address = F.concat(
        F.lit("http://198.51.100."), (key % 9).cast("string"), F.lit("/"), F.substring(F.lit("abcdef"), (1 + key % 6).cast("int"), F.lit(1)),
        F.when(key % 100 == 6, "").otherwise(key.cast("string")),
    )
    orders = table(spark, sf, "orders").select(address.alias("value"), F.lit(1).cast("long").alias("position"))
    extra = spark.createDataFrame([(v, i) for i, v in enumerate(EXTRA_INDICATORS, 2)], "value string, position long")
    listed = hosts.unionByName(orders).distinct().unionByName(extra).withColumn("signature_id", F.lit(301).cast("long"))
    rule = Rule("Long list", "", "ioc", "", "low", "host", signature_id=301)
    found = F.get_json_object("details", "$.command_line")
    matches = indicator_matches(host_events(spark, sf), [rule], listed)
    return matches.select("event_id", found.alias("found")).where("found IS NOT NULL")


class cut_always:
    """Within the block, ordered operators take the range-partitioned way."""

    def __init__(self, spark):
        self.spark = spark

    def __enter__(self):
        self.spark.conf.set(GROUP_LIMIT_CONF, "0")

    def __exit__(self, *_):
        self.spark.conf.unset(GROUP_LIMIT_CONF)


@query("threshold_cut_by_range", f"WITH {NET_SQL}, {HOST_SQL}, {THRESHOLD_SQL} {THRESHOLD_OUT}")
def threshold_cut_by_range(spark, sf):
    """The same rules the way hot keys are handled."""
    with cut_always(spark):
        return _threshold_rows(threshold_matches(all_events(spark, sf), TEST_RULES))


def _legacy_sql() -> str:
    parts = []
    for i, t, group, condition, threshold, seconds, conf in _threshold_specs(TEST_RULES):
        if condition is None:
            n = f"count(DISTINCT dst_port) OVER (PARTITION BY {group} ORDER BY us DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        else:
            n = f"row_number() OVER (PARTITION BY {group} ORDER BY us DESC, event_id DESC)"
        parts.append(
            f"SELECT event_id, CAST({i} AS BIGINT) AS signature_id, n AS n FROM (SELECT event_id, {n} AS n"
            f" FROM (SELECT *, epoch_us(ts) AS us FROM {t}) WHERE {group} IS NOT NULL) WHERE n >= {threshold}"
        )
    return " UNION ALL ".join(parts)


@query("threshold_alerts_legacy_desc", f"WITH {NET_SQL}, {HOST_SQL} {_legacy_sql()}")
def threshold_alerts_legacy_desc(spark, sf):
    """Newest first, no field conditions, nothing forgotten."""
    matches = threshold_matches(all_events(spark, sf), TEST_RULES, legacy=True)
    return matches.select(
        "event_id", "signature_id", F.get_json_object("details", "$.count").cast("long").alias("n")
    )


@query(
    "port_scan_distinct",
    f"""WITH {NET_SQL}, n AS (SELECT *, epoch_us(ts) AS us FROM net)
    SELECT event_id, count(DISTINCT dst_port) OVER (PARTITION BY src_ip ORDER BY us
      RANGE BETWEEN {86400 * US - 1} PRECEDING AND CURRENT ROW) AS n_ports,
      count(DISTINCT dst_port) OVER (PARTITION BY src_ip ORDER BY us
      RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_ports_ever FROM n""",
)
def port_scan_distinct(spark, sf):
    base = net_events(spark, sf).select(
        "event_id", "src_ip", "dst_port", micros(F.col("timestamp")).alias("us")
    )
    counts = [Distinct("n_ports", "dst_port", 86400 * US), Distinct("n_ports_ever", "dst_port", None)]
    out = trailing_distinct(base, ["src_ip"], "us", ["event_id"], counts)
    return out.select("event_id", "n_ports", "n_ports_ever")


WEEK_US = 7 * 86400 * US
TIES = "l_orderkey, l_linenumber, l_partkey"
LINE_SQL = f"""WITH l AS (SELECT *, epoch_us(l_shipdate) AS us FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  count(*) OVER w - count(*) OVER (PARTITION BY l_suppkey, us)
    + row_number() OVER (PARTITION BY l_suppkey, us ORDER BY {TIES}) AS n,
  count(DISTINCT l_partkey) OVER w AS n_parts
FROM l WINDOW w AS (PARTITION BY l_suppkey ORDER BY us RANGE BETWEEN {WEEK_US - 1} PRECEDING AND CURRENT ROW)"""


def _line_windows(spark, sf):
    base = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        micros(F.col("l_shipdate")).alias("us"),
    )
    ties = ["l_orderkey", "l_linenumber", "l_partkey"]
    out = trailing_distinct(base, ["l_suppkey"], "us", ties, [Distinct("n_parts", "l_partkey", WEEK_US)])
    out = trailing_sums(
        out, ["l_suppkey"], "us", ties, [Trailing("n", F.lit(1).cast("long"), WEEK_US)]
    )
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "n", "n_parts")


@query("threshold_daily_ties_lineitem", LINE_SQL)
def threshold_daily_ties_lineitem(spark, sf):
    """Trailing counts where many rows share one moment."""
    return _line_windows(spark, sf)


@query("threshold_ties_cut_by_range", LINE_SQL)
def threshold_ties_cut_by_range(spark, sf):
    """The same the way hot keys are handled."""
    with cut_always(spark):
        return _line_windows(spark, sf)


@query(
    "login_after_escalation",
    f"""WITH {HOST_SQL}, h AS (SELECT *, epoch_us(ts) AS us,
      max(CASE WHEN contains(command_line, 'sudo') THEN epoch_us(ts) END) OVER (
        PARTITION BY hostname ORDER BY epoch_us(ts), event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_sudo FROM host)
    SELECT event_id, us - last_sudo AS gap_us FROM h
    WHERE message = 'Login failed' AND us - last_sudo <= {6 * 3600 * US} AND us > last_sudo""",
)
def login_after_escalation(spark, sf):
    """A failed login within hours after a sudo on the same host."""
    rows = host_events(spark, sf).select(
        "event_id", "timestamp", "hostname", "command_line", "raw_data"
    )
    return followed_by(
        rows,
        ["hostname"],
        F.col("command_line").contains("sudo"),
        F.get_json_object("raw_data", "$.message") == "Login failed",
        6 * 3600,
    ).select("event_id", "gap_us")


@query(
    "fusion_score",
    ALERT_SQL
    + """, s AS (SELECT event_id, max(confidence) AS signature_score FROM alerts GROUP BY event_id),
    x AS (SELECT event_id, CAST(value / 500.0 AS DOUBLE) AS anomaly_score FROM events),
    f AS (SELECT coalesce(s.event_id, x.event_id) AS event_id, coalesce(signature_score, 0) AS sig,
      coalesce(anomaly_score, 0) AS ano FROM s FULL JOIN x ON s.event_id = x.event_id)
    SELECT event_id, round(sig * CAST(0.7 AS DOUBLE) + ano * CAST(0.3 AS DOUBLE), 6) AS fusion_score,
      CASE WHEN sig * 0.7::DOUBLE + ano * 0.3::DOUBLE >= 0.9::DOUBLE THEN 'critical'
        WHEN sig * 0.7::DOUBLE + ano * 0.3::DOUBLE >= 0.7::DOUBLE THEN 'high'
        WHEN sig * 0.7::DOUBLE + ano * 0.3::DOUBLE >= 0.5::DOUBLE THEN 'medium'
        WHEN sig * 0.7::DOUBLE + ano * 0.3::DOUBLE >= 0.3::DOUBLE THEN 'low' END AS severity FROM f""",
)
def fusion_score(spark, sf):
    """Signature alerts fused with an anomaly score taken from the event value."""
    scores = table(spark, sf, "events").select(
        "event_id",
        F.lit("anomaly").alias("detection_type"),
        (F.col("value") / 500.0).alias("confidence_score"),
    )
    alerts = rule_alerts(spark, sf).select("event_id", "detection_type", "confidence_score")
    return fused_scores(alerts.unionByName(scores)).select(
        "event_id", F.round("fusion_score", 6).alias("fusion_score"), "severity"
    )


@query(
    "all_matches_count",
    f"WITH {NET_SQL}, {HOST_SQL}, {PATTERN_SQL}, {THRESHOLD_SQL}, {IOC_SQL}"
    " SELECT event_id, count(*) AS n_rules FROM (SELECT event_id FROM pat UNION ALL SELECT event_id FROM thr"
    " UNION ALL SELECT event_id FROM ioc) GROUP BY event_id",
)
def all_matches_count(spark, sf):
    """Rules hit per event."""
    return (
        match_events(all_events(spark, sf), ALL_RULES)
        .groupBy("event_id")
        .agg(F.count(F.lit(1)).alias("n_rules"))
    )
