"""Queries over stored tables: counts, pages, change logs, lookups, groups."""

from pyspark.sql import functions as F

from contract.adapters import (
    ALL_RULES,
    HOST_SQL,
    NET_SQL,
    US,
    all_events,
    created_at,
    host_events,
    net_events,
    raw_events,
)
from contract.detection import IOC_SQL, NAMES, PATTERN_SQL, SEVERITY, THRESHOLD_SQL, _names_sql
from contract.registry import ORACLES, query, table
from palisade.functions.indicators import url_host
from palisade.operators import changelog as log
from palisade.operators import dedup, lookups, reports, rollups, similarity
from palisade.plans.detect import detect
from palisade.rules.matching import match_events
from palisade.rules.model import rules_frame
from palisade.plans.ingest import ingestion_report
from palisade.schemas import ALERT_SCHEMA
from palisade.session import scratch_path
from palisade.sources.sinks import write_alerts

NAME = _names_sql("signature_id", NAMES)
SEV = _names_sql("signature_id", SEVERITY)
STATUS = "CASE event_id % 7 WHEN 0 THEN 'investigating' WHEN 1 THEN 'resolved' WHEN 2 THEN 'false_positive' ELSE 'new' END"

# Alerts of all rules on all events, created at event time, with a status by event id.
ALERTS_SQL = f"""{NET_SQL}, {HOST_SQL}, {PATTERN_SQL}, {THRESHOLD_SQL}, {IOC_SQL},
matched AS (SELECT event_id, signature_id, confidence FROM pat
  UNION ALL SELECT event_id, signature_id, confidence FROM thr
  UNION ALL SELECT event_id, signature_id, confidence FROM ioc),
alerts AS (SELECT md5(p.event_id || ':' || {NAME}) AS alert_id, p.event_id, signature_id,
  {NAME} AS title, {SEV} AS severity, {STATUS.replace("event_id", "p.event_id")} AS status,
  confidence AS confidence_score, e.ts AS created_at
  FROM matched p JOIN (SELECT event_id, ts FROM net UNION ALL SELECT event_id, ts FROM host) e
    ON p.event_id = e.event_id)"""


_STORED: dict[tuple[str, str], str] = {}


def alert_table(spark, sf):
    """The stored alerts of all rules. Like events they are stored once per session, as
    reports run on stored alerts."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORED:
        path = scratch_path(spark, "stored-alerts")
        write_alerts(detect(all_events(spark, sf), ALL_RULES, F.col("timestamp")), path)
        _STORED[key] = path
    alerts = spark.read.schema(ALERT_SCHEMA).parquet(_STORED[key])
    return alerts.withColumn("status", F.expr(STATUS))


# Indicator sightings made from events.
SIGHTING = {
    "seq": "event_id",
    "moment": "ts",
    "op": "CASE WHEN k % 15 = 0 THEN 'deactivate' ELSE 'seen' END",
    "ioc_type": "CASE k % 4 WHEN 0 THEN 'ip' WHEN 1 THEN 'domain' WHEN 2 THEN 'hash' WHEN 3 THEN 'ip' END",
    "value": "CASE WHEN k = 7 THEN NULL WHEN k % 2 = 0 THEN concat('203.0.113.', CAST(user_id AS STRING))"
    " WHEN k % 4 = 1 THEN concat('bad', CAST(user_id AS STRING), '.example.com')"
    " ELSE concat('10.0.', CAST(user_id % 4 AS STRING), '.', CAST(user_id AS STRING)) END",
    "threat_type": "CASE WHEN k % 5 = 0 THEN 'c2' ELSE 'unknown' END",
    "confidence": "CASE WHEN k % 3 = 0 THEN CAST(k AS DOUBLE) / 100 END",
    "severity": "CASE WHEN k % 6 = 0 THEN 'high' ELSE 'medium' END",
    "source": "CASE WHEN k % 8 <> 0 THEN raw_type END",
    "is_active": "CASE WHEN k % 10 = 1 THEN FALSE WHEN k % 10 = 2 THEN TRUE END",
    "description": "CASE WHEN k % 9 <> 0 THEN concat('seen ', CAST(k AS STRING)) END",
    "tags": "CASE WHEN k % 7 <> 0 THEN split(concat(raw_type, ',', CAST(k AS STRING)), ',') END",
}


def _select(exprs):
    return ", ".join(f"{e} AS {a}" for a, e in exprs.items())


RAW = "(SELECT event_id, ts, user_id, event_type AS raw_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)"
IOCS_SQL = f"""sightings AS (SELECT {_select(SIGHTING)} FROM {RAW}),
iocs AS (SELECT ioc_type, value,
  arg_min(threat_type, seq) FILTER (op = 'seen') AS threat_type,
  arg_min(severity, seq) FILTER (op = 'seen') AS severity,
  first(description ORDER BY seq) FILTER (op = 'seen') AS description,
  first(tags ORDER BY seq) FILTER (op = 'seen') AS tags,
  coalesce(first(source ORDER BY seq) FILTER (op = 'seen'), 'manual') AS source,
  coalesce(arg_max(confidence, seq) FILTER (op = 'seen' AND confidence IS NOT NULL), 0.5) AS confidence,
  arg_max(CASE WHEN op = 'seen' THEN coalesce(is_active, TRUE) ELSE FALSE END, seq) AS is_active,
  min(moment) FILTER (op = 'seen') AS first_seen, max(moment) FILTER (op = 'seen') AS last_seen
  FROM sightings WHERE ioc_type IS NOT NULL AND value IS NOT NULL
  GROUP BY ioc_type, value HAVING count(*) FILTER (op = 'seen') > 0)"""


def sightings(spark, sf):
    rows = raw_events(spark, sf).selectExpr(*[f"{e} AS {a}" for a, e in SIGHTING.items()])
    return rows.withColumn("at", F.col("moment").cast("timestamp")).drop("moment")


def ioc_table(spark, sf):
    return log.current_iocs(sightings(spark, sf))


def us(name):
    return F.unix_micros(name).alias(name.replace("_at", "").replace("_seen", "") + "_us")


@query(
    "event_counts_rollup",
    f"""WITH {NET_SQL}, {HOST_SQL}, e AS (SELECT event_type FROM net UNION ALL SELECT event_type FROM host)
    SELECT event_type, count(*) AS n_events FROM e GROUP BY event_type
    UNION ALL SELECT 'total', count(*) FROM e""",
)
def event_counts_rollup(spark, sf):
    return ingestion_report(all_events(spark, sf))


@query(
    "alert_count_filtered",
    f"""WITH {ALERTS_SQL} SELECT 'critical' AS severity, 'new' AS status, count(*) AS n_alerts FROM alerts
    WHERE severity = 'critical' AND status = 'new'""",
)
def alert_count_filtered(spark, sf):
    counted = reports.alert_count(alert_table(spark, sf), severity="critical", status="new")
    return counted.select(
        F.lit("critical").alias("severity"), F.lit("new").alias("status"), "n_alerts"
    )


@query(
    "alert_severity_stats",
    f"""WITH {ALERTS_SQL} SELECT count(*) AS total,
    {", ".join(f"count(*) FILTER (status = '{s}') AS status_{s}" for s in reports.STATUSES)},
    {", ".join(f"count(*) FILTER (severity = '{s}') AS severity_{s}" for s in reports.SEVERITIES)} FROM alerts""",
)
def alert_severity_stats(spark, sf):
    return reports.alert_statistics(alert_table(spark, sf))


@query(
    "ioc_type_stats",
    f"""WITH {IOCS_SQL} SELECT count(*) AS total, count(*) FILTER (is_active) AS active,
    {", ".join(f"count(*) FILTER (is_active AND ioc_type = '{t}') AS active_{t}" for t in reports.IOC_TYPES)} FROM iocs""",
)
def ioc_type_stats(spark, sf):
    return reports.ioc_statistics(ioc_table(spark, sf))


@query(
    "detection_run_stats",
    f"""WITH {ALERTS_SQL} SELECT (SELECT count(*) FROM net) + (SELECT count(*) FROM host) AS events_processed,
    count(*) AS alerts_generated,
    {", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in reports.SEVERITIES)} FROM alerts""",
)
def detection_run_stats(spark, sf):
    return reports.detection_statistics(all_events(spark, sf), alert_table(spark, sf))


@query(
    "severity_counts",
    f"WITH {ALERTS_SQL} SELECT severity, count(*) AS n_alerts FROM alerts GROUP BY severity",
)
def severity_counts(spark, sf):
    return reports.severity_counts(alert_table(spark, sf))


@query(
    "anomaly_batch_stats",
    """SELECT count(*) AS events_processed, count(*) FILTER (value / 500 > 0.5) AS anomalies_detected,
    count(*) FILTER (value / 500 > 0.5) AS alerts_generated FROM events""",
)
def anomaly_batch_stats(spark, sf):
    scored = table(spark, sf, "events").withColumn("score", F.col("value") / 500)
    return reports.anomaly_statistics(scored, "score")


@query(
    "label_distribution",
    "SELECT count(*) FILTER (toxic = 0) AS benign, count(*) FILTER (toxic = 1) AS attack FROM labels",
)
def label_distribution(spark, sf):
    return reports.label_distribution(table(spark, sf, "labels"), "toxic")


@query(
    "ingest_and_detect_report",
    f"""WITH {ALERTS_SQL} SELECT (SELECT count(*) FROM net) AS network, (SELECT count(*) FROM host) AS host,
    (SELECT count(*) FROM net) + (SELECT count(*) FROM host) AS total,
    count(*) AS alerts_generated, count(*) FILTER (severity = 'critical') AS critical,
    count(*) FILTER (severity = 'low') AS low FROM alerts""",
)
def ingest_and_detect_report(spark, sf):
    return reports.pipeline_report(all_events(spark, sf), alert_table(spark, sf)).select(
        "ingestion.*", "detection.alerts_generated", "detection.critical", "detection.low"
    )


# Rules with the events that matched them, so the rule counters follow the data.
RULE_USE_SQL = "used AS (SELECT DISTINCT signature_id FROM matched)"


def used_rules(spark, found):
    """The rule table with ``enabled`` set only for rules of which there are matches, or stored alerts."""
    used = found.select("signature_id").distinct()
    return (
        rules_frame(spark, ALL_RULES)
        .join(used.withColumn("used", F.lit(True)), "signature_id", "left")
        .withColumn("enabled", F.coalesce("used", F.lit(False)))
        .drop("used")
    )


@query(
    "rule_stats",
    f"WITH {ALERTS_SQL}, {RULE_USE_SQL} SELECT count(*) AS enabled, CAST({len(ALL_RULES)} AS BIGINT) AS total FROM used",
)
def rule_stats(spark, sf):
    return reports.rule_statistics(used_rules(spark, match_events(all_events(spark, sf), ALL_RULES)))


@query(
    "dashboard_long",
    f"""WITH {ALERTS_SQL}, {IOCS_SQL}, {RULE_USE_SQL}
    SELECT 'events' AS section, 'network' AS metric, count(*) AS value FROM net
    UNION ALL SELECT 'events', 'host', count(*) FROM host
    UNION ALL SELECT 'events', 'total', (SELECT count(*) FROM net) + (SELECT count(*) FROM host)
    UNION ALL SELECT 'alerts', 'total', count(*) FROM alerts
    {" ".join(f"UNION ALL SELECT 'alerts', 'status_{s}', count(*) FILTER (status = '{s}') FROM alerts" for s in reports.STATUSES)}
    {" ".join(f"UNION ALL SELECT 'alerts', 'severity_{s}', count(*) FILTER (severity = '{s}') FROM alerts" for s in reports.SEVERITIES)}
    UNION ALL SELECT 'signatures', 'enabled', count(*) FROM used
    UNION ALL SELECT 'signatures', 'total', CAST({len(ALL_RULES)} AS BIGINT)
    UNION ALL SELECT 'iocs', 'total', count(*) FROM iocs
    UNION ALL SELECT 'iocs', 'active', count(*) FILTER (is_active) FROM iocs
    {" ".join(f"UNION ALL SELECT 'iocs', 'active_{t}', count(*) FILTER (is_active AND ioc_type = '{t}') FROM iocs" for t in reports.IOC_TYPES)}""",
)
def dashboard_long(spark, sf):
    alerts = alert_table(spark, sf)
    return reports.dashboard(all_events(spark, sf), alerts, used_rules(spark, alerts), ioc_table(spark, sf))


@query("dashboard_incremental", ORACLES["dashboard_long"])
def dashboard_incremental(spark, sf):
    """The same from partial aggregates, stored by each of three runs of its own rows alone, and from
    indicator changes that were compacted in between. The second run is repeated."""
    path, changes = scratch_path(spark, "rollups"), scratch_path(spark, "ioc-changes")
    events, alerts, seen = all_events(spark, sf), alert_table(spark, sf), sightings(spark, sf)
    part = lambda df, number, time: df.where(F.pmod(F.dayofmonth(time), F.lit(3)) == number)
    for number in (0, 1, 1, 2):
        partial = [rollups.event_partials(part(events, number, "timestamp")), rollups.alert_partials(part(alerts, number, "event_time"))]
        rollups.store(path, number, *partial)
        rows = part(seen, number, "at")
        log.append_changes(rows, changes, number)
        log.compact(spark, changes, rows.schema, log.IOC_KEYS, log.ioc_witnesses())
    iocs = log.current_iocs(log.read_changes(spark, changes, seen.schema))
    return rollups.dashboard(rollups.read(spark, path), used_rules(spark, alerts), iocs)


@query(
    "event_rollup_report",
    f"""WITH {NET_SQL} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n_events, CAST(sum(bytes_sent) AS BIGINT) AS bytes_sent,
    epoch_us(max(ts)) AS latest_us, count(DISTINCT src_ip) AS n_sources FROM net GROUP BY 1""",
)
def event_rollup_report(spark, sf):
    """Daily totals of network events folded from the partial aggregates of three runs, each over rows of all days; the
    sketches of sources are exact at this size."""
    path = scratch_path(spark, "daily")
    for number in range(3):
        rollups.store(path, number, rollups.event_partials(net_events(spark, sf).where(F.col("event_id") % 3 == number)))
    daily = rollups.daily_totals(rollups.read(spark, path))
    return daily.select(F.col("day").cast("string"), "n_events", "bytes_sent", F.unix_micros("latest").alias("latest_us"), F.col("n_sources"))


SIMILAR_SQL = f"""{ALERTS_SQL}, texts AS (
  SELECT alert_id, lower(title || ' ' || coalesce(process_name, '') || ' ' || coalesce(command_line, '') || ' ' || coalesce(parent_process, '')) AS t
  FROM alerts JOIN host USING (event_id)),
words AS (SELECT alert_id, list_sort(list_distinct(list_filter(regexp_split_to_array(t, '[^a-z0-9.]+'), lambda w: w <> ''))) AS w FROM texts),
rows AS (SELECT alert_id, w, md5(array_to_string(w, ' ')) AS s FROM words),
sets AS (SELECT DISTINCT s, w FROM rows WHERE len(w) > 0),
links AS (SELECT a.s AS a, b.s AS b FROM sets a JOIN sets b ON a.s <> b.s
  AND len(list_intersect(a.w, b.w)) >= 0.6 * len(list_distinct(list_concat(a.w, b.w)))),
reach AS (SELECT s AS a, s AS b FROM (SELECT DISTINCT s FROM rows) UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)"""


@query(
    "alert_similar_classes",
    f"""WITH RECURSIVE {SIMILAR_SQL}, c AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a),
    d AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT alert_id, class_id, coalesce(n, 0) AS n_similar FROM rows JOIN c ON c.a = s LEFT JOIN d ON d.a = s""",
)
def alert_similar_classes(spark, sf):
    """Host alerts by the words of their title and event: classes of those that share at least 0.6."""
    parts = ["title", "process_name", "command_line", "parent_process"]
    text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in parts])
    rows = alert_table(spark, sf).select("alert_id", "event_id", "title").join(host_events(spark, sf).select("event_id", *parts[1:]), "event_id")
    return similarity.similar_classes(rows, "alert_id", text, 0.6).select("alert_id", "class_id", "n_similar")


@query(
    "recent_events_page",
    f"""WITH {NET_SQL} SELECT event_id, epoch_us(ts) AS ts_us, src_ip FROM net
    ORDER BY ts DESC, event_id DESC LIMIT 100 OFFSET 200""",
)
def recent_events_page(spark, sf):
    rows = reports.page(
        all_events(spark, sf), "timestamp", "event_id", 100, 200, event_type="network"
    )
    return rows.select("event_id", F.unix_micros("timestamp").alias("ts_us"), "src_ip")


@query(
    "alerts_page",
    f"""WITH {ALERTS_SQL} SELECT alert_id, title, epoch_us(created_at) AS created_us FROM alerts
    WHERE severity = 'critical' AND status = 'new'
    ORDER BY created_at DESC, alert_id DESC LIMIT 50 OFFSET 10""",
)
def alerts_page(spark, sf):
    rows = reports.page(
        alert_table(spark, sf), "created_at", "alert_id", 50, 10, severity="critical", status="new"
    )
    return rows.select("alert_id", "title", F.unix_micros("created_at").alias("created_us"))


@query(
    "rules_enabled_list",
    f"WITH {ALERTS_SQL}, {RULE_USE_SQL} SELECT CAST(signature_id AS BIGINT) AS signature_id, {NAME} AS name FROM used",
)
def rules_enabled_list(spark, sf):
    used = used_rules(spark, match_events(all_events(spark, sf), ALL_RULES))
    return used.where("enabled").select("signature_id", "name")


@query(
    "iocs_by_type",
    f"WITH {IOCS_SQL} SELECT value, threat_type, round(confidence, 6) AS confidence FROM iocs WHERE ioc_type = 'domain' AND is_active",
)
def iocs_by_type(spark, sf):
    rows = lookups.active_iocs(ioc_table(spark, sf), "domain")
    return rows.select("value", "threat_type", F.round("confidence", 6).alias("confidence"))


@query(
    "ioc_upsert_latest",
    f"""WITH {IOCS_SQL} SELECT ioc_type, value, threat_type, severity, source, round(confidence, 6) AS confidence,
    is_active, epoch_us(first_seen) AS first_us, epoch_us(last_seen) AS last_us, description,
    array_to_string(tags, ';') AS tags FROM iocs""",
)
def ioc_upsert_latest(spark, sf):
    return ioc_table(spark, sf).select(
        "ioc_type", "value", "threat_type", "severity", "source",
        F.round("confidence", 6).alias("confidence"), "is_active", us("first_seen"), us("last_seen"),
        "description", F.array_join("tags", ";").alias("tags"),
    )


@query("changelog_compacted", ORACLES["ioc_upsert_latest"])
def changelog_compacted(spark, sf):
    """The same from a log that was compacted three times, and a rest that was not."""
    path = scratch_path(spark, "ioc-log")
    rows = sightings(spark, sf)
    for number in range(4):
        log.append_changes(rows.where(F.pmod(F.xxhash64("seq"), F.lit(4)) == number), path, number)
        if number < 3:
            log.compact(spark, path, rows.schema, log.IOC_KEYS, log.ioc_witnesses())
    return log.current_iocs(log.read_changes(spark, path, rows.schema)).select(
        "ioc_type", "value", "threat_type", "severity", "source",
        F.round("confidence", 6).alias("confidence"), "is_active", us("first_seen"), us("last_seen"),
        "description", F.array_join("tags", ";").alias("tags"),
    )


@query(
    "ioc_feed_counts",
    f"""WITH {IOCS_SQL} SELECT coalesce(source, 'none') AS source,
    count(*) FILTER (ioc_type IS NOT NULL AND value IS NOT NULL) AS n_iocs FROM sightings GROUP BY 1""",
)
def ioc_feed_counts(spark, sf):
    rows = sightings(spark, sf).withColumn("source", F.coalesce("source", F.lit("none")))
    return log.feed_counts(rows)


@query(
    "ioc_table_hits",
    f"""WITH {NET_SQL}, {IOCS_SQL},
    v AS (SELECT event_id, 'src_ip' AS field, src_ip AS value FROM net
      UNION ALL SELECT event_id, 'dst_ip', dst_ip FROM net)
    SELECT event_id, field, v.value, round(confidence, 6) AS confidence FROM v
    JOIN iocs ON iocs.value = v.value AND ioc_type = 'ip' AND is_active""",
)
def ioc_table_hits(spark, sf):
    hits = lookups.ioc_hits(
        net_events(spark, sf), "event_id", {"src_ip": "ip", "dst_ip": "ip"}, ioc_table(spark, sf)
    )
    return hits.select("event_id", "field", "value", F.round("confidence", 6).alias("confidence"))


DOMAIN_IOCS_SQL = """d AS (SELECT 'domain' AS ioc_type, value, count(*) AS n FROM (
  SELECT lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS value FROM pages) GROUP BY value HAVING count(*) >= 2)"""


@query(
    "ioc_domain_hits",
    f"""WITH {DOMAIN_IOCS_SQL} SELECT page_id, d.value FROM pages
    JOIN d ON d.value = lower(regexp_extract(url, '^https?://([^/?#:]+)', 1))""",
)
def ioc_domain_hits(spark, sf):
    """Pages whose host is listed; the list is every host seen at least twice."""
    pages = table(spark, sf, "pages").select("page_id", url_host(F.col("url")).alias("host"))
    listed = (
        pages.groupBy(F.col("host").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n >= 2")
        .select(
            F.lit("domain").alias("ioc_type"), "value", F.lit("test").alias("threat_type"),
            F.lit(0.5).alias("confidence"), F.lit("low").alias("severity"), F.lit(True).alias("is_active"),
        )
    )
    return lookups.ioc_hits(pages, "page_id", {"host": "domain"}, listed).select("page_id", "value")


@query(
    "alert_threat_intel",
    f"""WITH {ALERTS_SQL}, {IOCS_SQL},
    v AS (SELECT event_id, 'src_ip' AS field, src_ip AS value FROM net
      UNION ALL SELECT event_id, 'dst_ip', dst_ip FROM net),
    h AS (SELECT event_id, max(confidence) AS confidence FROM v
      JOIN iocs ON iocs.value = v.value AND ioc_type = 'ip' AND is_active GROUP BY event_id)
    SELECT alert_id, round(h.confidence, 6) AS best_confidence FROM alerts LEFT JOIN h USING (event_id)""",
)
def alert_threat_intel(spark, sf):
    hits = lookups.ioc_hits(
        net_events(spark, sf), "event_id", {"src_ip": "ip", "dst_ip": "ip"}, ioc_table(spark, sf)
    )
    out = lookups.with_threat_intel(alert_table(spark, sf), hits)
    best = F.get_json_object("threat_intel", "$.confidence").cast("double")
    return out.select("alert_id", F.round(best, 6).alias("best_confidence"))


@query(
    "alert_asset_criticality",
    f"""WITH {ALERTS_SQL}, a AS (SELECT DISTINCT 'host' || (user_id % 20) AS hostname,
      CASE WHEN user_id % 20 < 5 THEN 'high' ELSE 'low' END AS criticality FROM events WHERE user_id % 20 <> 7)
    SELECT alert_id, coalesce(criticality, 'unknown') AS asset_criticality
    FROM alerts LEFT JOIN host USING (event_id) LEFT JOIN a USING (hostname)""",
)
def alert_asset_criticality(spark, sf):
    hosts = host_events(spark, sf).select("event_id", "hostname")
    alerts = lookups.alerts_with_events(
        alert_table(spark, sf).select("alert_id", "event_id"),
        all_events(spark, sf).select("event_id", "hostname"),
    )
    assets = (
        hosts.select("hostname").distinct().where("hostname <> 'host7'").withColumn(
            "criticality",
            F.when(F.substring("hostname", 5, 9).cast("int") < 5, "high").otherwise("low"),
        )
    )
    return lookups.with_criticality(alerts, assets, "hostname").select(
        "alert_id", "asset_criticality"
    )


@query(
    "alerts_with_events",
    f"""WITH {ALERTS_SQL} SELECT alert_id, title, src_ip, dst_port, bytes_sent FROM alerts JOIN net USING (event_id)""",
)
def alerts_with_events(spark, sf):
    joined = lookups.alerts_with_events(
        alert_table(spark, sf).select("alert_id", "event_id", "title"),
        net_events(spark, sf).select("event_id", "src_ip", "dst_port", "bytes_sent"),
    )
    return joined.select("alert_id", "title", "src_ip", "dst_port", "bytes_sent")


@query(
    "newest_id_per_moment",
    """SELECT epoch_us(l_shipdate) AS moment_us, l_returnflag AS event_type, max(l_orderkey) AS event_id
    FROM lineitem GROUP BY l_shipdate, l_returnflag""",
)
def newest_id_per_moment(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        F.col("l_returnflag").alias("event_type"),
        F.col("l_orderkey").alias("event_id"),
    )
    out = lookups.newest_id_per_moment(rows)
    return out.select(F.unix_micros("timestamp").alias("moment_us"), "event_type", "event_id")


@query(
    "alert_comments_join",
    f"""WITH {ALERTS_SQL}, c AS (SELECT conv_id, turn, role, text FROM conversations)
    SELECT alert_id, role AS author, turn FROM alerts LEFT JOIN c ON conv_id = alerts.event_id
    """,
)
def alert_comments_join(spark, sf):
    """Conversation turns as comments on the alerts of the event of the same number."""
    alerts = alert_table(spark, sf).select("alert_id", "event_id")
    turns = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("event_id"), F.col("role").alias("author"),
        F.col("text").alias("comment"), F.timestamp_seconds("turn").alias("created_at"),
    )
    comments = turns.join(alerts, "event_id").select("alert_id", "author", "comment", "created_at")
    joined = lookups.alerts_with_comments(alerts, comments)
    return joined.select("alert_id", "author", F.unix_seconds("commented_at").alias("turn"))


RULE_CHANGE = {
    "signature_id": "user_id",
    "seq": "event_id",
    "op": "CASE WHEN k = 99 THEN 'delete' WHEN k % 12 = 0 THEN 'add' WHEN k % 12 = 5 THEN 'disable'"
    " WHEN k % 12 = 7 THEN 'enable' ELSE 'update' END",
    "enabled": "CASE WHEN k = 30 THEN FALSE END",
    "name": "CASE WHEN k % 12 = 0 THEN concat('rule', CAST(user_id AS STRING)) END",
    "severity": "CASE k % 9 WHEN 0 THEN 'low' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' END",
    "confidence": "CASE WHEN k % 5 = 0 THEN CAST(k AS DOUBLE) / 100 END",
}


def rule_changes(spark, sf):
    return raw_events(spark, sf).selectExpr(*[f"{e} AS {a}" for a, e in RULE_CHANGE.items()])


@query(
    "rules_latest",
    f"""WITH c AS (SELECT {_select(RULE_CHANGE)} FROM {RAW}),
    e AS (SELECT *, CASE op WHEN 'enable' THEN TRUE WHEN 'disable' THEN FALSE ELSE enabled END AS en FROM c)
    SELECT signature_id, arg_max(name, seq) FILTER (name IS NOT NULL) AS name,
      arg_max(severity, seq) FILTER (severity IS NOT NULL) AS severity,
      round(arg_max(confidence, seq) FILTER (confidence IS NOT NULL), 6) AS confidence,
      coalesce(arg_max(en, seq) FILTER (en IS NOT NULL), TRUE) AS enabled
    FROM e GROUP BY signature_id
    HAVING count(*) FILTER (op = 'add') > 0 AND count(*) FILTER (op = 'delete') = 0""",
)
def rules_latest(spark, sf):
    current = log.current_rules(rule_changes(spark, sf), ["name", "severity", "confidence"])
    return current.select(
        "signature_id", "name", "severity", F.round("confidence", 6).alias("confidence"), "enabled"
    )


def _rule_names(spark, sf):
    """Customers as candidate rules; those with a very large order count as loaded."""
    names = table(spark, sf, "customer").select(F.col("c_name").alias("name"), "c_custkey")
    large = table(spark, sf, "orders").where("o_totalprice > 450000")
    loaded = names.join(large.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")
    return names, loaded


@query(
    "rules_missing_anti",
    """SELECT DISTINCT c_name AS name FROM customer WHERE c_name NOT IN (
      SELECT c_name FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 450000)""",
)
def rules_missing_anti(spark, sf):
    """Names that are not loaded yet."""
    return log.missing_rules(*_rule_names(spark, sf)).select("name").distinct()


@query(
    "rule_load_counts",
    """WITH o AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 450000)
    SELECT count(*) FILTER (o_custkey IS NULL) AS loaded, count(*) FILTER (o_custkey IS NOT NULL) AS skipped
    FROM customer LEFT JOIN o ON c_custkey = o_custkey""",
)
def rule_load_counts(spark, sf):
    return log.load_counts(*_rule_names(spark, sf))


@query(
    "rule_last_matched",
    f"WITH {ALERTS_SQL} SELECT CAST(signature_id AS BIGINT) AS signature_id, epoch_us(max(created_at)) AS last_us FROM alerts GROUP BY signature_id",
)
def rule_last_matched(spark, sf):
    out = log.last_matched(alert_table(spark, sf))
    return out.select("signature_id", F.unix_micros("last_matched").alias("last_us"))


STATE_CHANGE = {
    "alert_id": "CAST(user_id AS STRING)",
    "seq": "event_id",
    "moment": "ts",
    "status": "CASE raw_type WHEN 'view' THEN 'investigating' WHEN 'error' THEN 'resolved'"
    " WHEN 'signup' THEN 'false_positive' ELSE 'new' END",
    "notes": "CASE WHEN k % 10 = 0 THEN concat('note ', CAST(k AS STRING)) WHEN k % 10 = 1 THEN '' END",
}


@query(
    "alert_lifecycle",
    f"""WITH c AS (SELECT {_select(STATE_CHANGE)} FROM {RAW})
    SELECT alert_id, arg_max(status, seq) AS status,
      epoch_us(arg_max(moment, seq) FILTER (status = 'investigating')) AS investigated_us,
      epoch_us(arg_max(moment, seq) FILTER (status IN ('resolved', 'false_positive'))) AS resolved_us,
      coalesce(arg_max(status = 'false_positive', seq) FILTER (status IN ('resolved', 'false_positive')), FALSE) AS false_positive,
      arg_max(notes, seq) FILTER (notes <> '') AS resolution_notes,
      epoch_us(max(moment)) AS updated_us
    FROM c GROUP BY alert_id""",
)
def alert_lifecycle(spark, sf):
    changes = (
        raw_events(spark, sf)
        .selectExpr(*[f"{e} AS {a}" for a, e in STATE_CHANGE.items()])
        .withColumn("at", F.col("moment").cast("timestamp"))
    )
    return log.alert_states(changes).select(
        "alert_id", "status", us("investigated_at"), us("resolved_at"), "false_positive",
        "resolution_notes", us("updated_at"),
    )


@query(
    "alerts_current_status",
    f"WITH {ALERTS_SQL} SELECT alert_id, CASE WHEN severity = 'low' THEN 'resolved' ELSE status END AS status FROM alerts",
)
def alerts_current_status(spark, sf):
    alerts = alert_table(spark, sf)
    changes = alerts.where("severity = 'low'").select(
        "alert_id", F.col("event_id").alias("seq"), F.col("created_at").alias("at"),
        F.lit("resolved").alias("status"), F.lit(None).cast("string").alias("notes"),
    )
    return log.apply_states(alerts, log.alert_states(changes)).select("alert_id", "status")


MODEL = {
    "model_type": "CASE user_id % 3 WHEN 0 THEN 'isolation_forest' WHEN 1 THEN 'one_class_svm' ELSE 'autoencoder' END",
    "seq": "event_id",
    "name": "raw_type",
    "training_samples": "CAST(k AS BIGINT)",
}


@query(
    "registry_active",
    f"""WITH m AS (SELECT {_select(MODEL)} FROM {RAW})
    SELECT model_type, max(seq) AS seq, arg_max(name, seq) AS name, arg_max(training_samples, seq) AS training_samples
    FROM m GROUP BY model_type""",
)
def registry_active(spark, sf):
    models = raw_events(spark, sf).selectExpr(*[f"{e} AS {a}" for a, e in MODEL.items()])
    return log.active_models(models).select("model_type", "seq", "name", "training_samples")


@query(
    "registry_states",
    f"""WITH m AS (SELECT {_select(MODEL)} FROM {RAW})
    SELECT model_type, seq, seq = max(seq) OVER (PARTITION BY model_type) AS is_active FROM m""",
)
def registry_states(spark, sf):
    models = raw_events(spark, sf).selectExpr(*[f"{e} AS {a}" for a, e in MODEL.items()])
    return log.registry(models).select("model_type", "seq", "is_active")


GAP_US = 12 * 3600 * US
GROUP_SQL = f"""h AS (SELECT alert_id, alerts.event_id, title, severity, hostname, command_line, epoch_us(created_at) AS us
  FROM alerts JOIN (SELECT event_id, hostname, command_line FROM host
    UNION ALL SELECT event_id, src_ip, concat_ws(' ', dst_ip, dst_port) FROM net) USING (event_id)),
g AS (SELECT *, CASE WHEN us - lag(us) OVER w <= {GAP_US} THEN 0 ELSE 1 END AS starts FROM h
  WINDOW w AS (PARTITION BY title, hostname ORDER BY us, alert_id)),
r AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY title, hostname ORDER BY us, alert_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS group_no FROM g)"""


def host_alerts(spark, sf):
    """Alerts with what they are about: the host, or the source address of network events."""
    alerts = alert_table(spark, sf).select("alert_id", "event_id", "title", "severity", "created_at")
    about = all_events(spark, sf).select(
        "event_id",
        F.coalesce("hostname", "src_ip").alias("hostname"),
        F.when(F.col("event_type") == "host", F.col("command_line"))
        .otherwise(F.concat_ws(" ", "dst_ip", F.col("dst_port").cast("string")))
        .alias("command_line"),
    )
    return lookups.alerts_with_events(alerts, about)


@query(
    "alert_dedup_gap",
    f"WITH {ALERTS_SQL}, {GROUP_SQL} SELECT alert_id, group_no, starts = 0 AS is_duplicate FROM r",
)
def alert_dedup_gap(spark, sf):
    groups = dedup.alert_groups(
        host_alerts(spark, sf), ["title", "hostname"], "created_at", "alert_id",
        window_seconds=12 * 3600,
    )
    return groups.select("alert_id", "group_no", "is_duplicate")


@query(
    "alert_dedup_similarity",
    f"""WITH {ALERTS_SQL}, h AS (SELECT alert_id, hostname, title, epoch_us(created_at) AS us,
      list_distinct(list_filter(regexp_split_to_array(lower(coalesce(command_line, '')), '[^a-z0-9.]+'), lambda x: x <> '')) AS words
      FROM alerts JOIN (SELECT event_id, hostname, command_line FROM host
        UNION ALL SELECT event_id, src_ip, concat_ws(' ', dst_ip, dst_port) FROM net) USING (event_id)),
    p AS (SELECT *, lag(us) OVER w AS prev_us, lag(words) OVER w AS prev FROM h
      WINDOW w AS (PARTITION BY title, hostname ORDER BY us, alert_id))
    SELECT alert_id, CASE WHEN prev_us IS NULL OR us - prev_us > {3 * 86400 * US} THEN FALSE
      WHEN len(list_distinct(words || prev)) = 0 THEN TRUE
      ELSE len(list_intersect(words, prev)) / len(list_distinct(words || prev)) >= 0.8 END AS is_duplicate FROM p""",
)
def alert_dedup_similarity(spark, sf):
    rows = host_alerts(spark, sf).withColumn("command_line", F.coalesce("command_line", F.lit("")))
    groups = dedup.alert_groups(
        rows, ["title", "hostname"], "created_at", "alert_id", text="command_line",
        window_seconds=3 * 86400,
    )
    return groups.select("alert_id", "is_duplicate")


@query(
    "incident_links",
    f"""WITH {ALERTS_SQL}, {GROUP_SQL}
    SELECT alert_id, md5(title || '|' || hostname || '|' || group_no) AS incident_id FROM r""",
)
def incident_links(spark, sf):
    return _links(spark, sf).select("alert_id", "incident_id")


def _links(spark, sf):
    keys = ["title", "hostname"]
    groups = dedup.alert_groups(
        host_alerts(spark, sf), keys, "created_at", "alert_id", window_seconds=12 * 3600
    )
    return dedup.incident_links(groups, keys)


@query(
    "incident_summary",
    f"""WITH {ALERTS_SQL}, {GROUP_SQL}
    SELECT md5(title || '|' || hostname || '|' || group_no) AS incident_id, count(*) AS n_alerts,
      any_value(severity) AS severity, 'open' AS status, min(us) AS first_us, max(us) AS last_us
    FROM r GROUP BY title, hostname, group_no""",
)
def incident_summary(spark, sf):
    out = dedup.incidents(_links(spark, sf), "created_at")
    return out.select(
        "incident_id", "n_alerts", "severity", "status",
        F.unix_micros("first_alert_at").alias("first_us"),
        F.unix_micros("last_alert_at").alias("last_us"),
    )


@query(
    "retention_by_day",
    f"""WITH {ALERTS_SQL} SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n FROM alerts
    WHERE created_at >= TIMESTAMP '2024-02-01' - INTERVAL 15 DAY GROUP BY 1""",
)
def retention_by_day(spark, sf):
    kept = reports.retained(alert_table(spark, sf), "created_at", created_at(), days=15)
    return kept.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("n")
    )
