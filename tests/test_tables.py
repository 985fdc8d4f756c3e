"""Change logs, reports, lookups, grouping."""

from helpers import at, events, rows
from pyspark.sql import functions as F

from palisade.operators import changelog as log
from palisade.operators import dedup, lookups, reports
from palisade.operators.alerts import fused_scores, mean_score


def test_rule_changes(spark):
    df = spark.createDataFrame(
        [
            (1, 1, "add", None, "a", "low"), (1, 2, "update", None, None, "high"), (1, 3, "disable", None, None, None),
            (2, 1, "add", False, "b", "low"), (2, 2, "enable", None, None, None),
            (3, 1, "add", None, "c", "low"), (3, 2, "delete", None, None, None),
            (4, 1, "update", None, "d", "low"), (5, 1, "add", None, "e", "low"),
        ],
        "signature_id long, seq long, op string, enabled boolean, name string, severity string",
    )
    assert rows(log.current_rules(df, ["name", "severity"]), "signature_id") == [
        (1, "a", "high", False), (2, "b", "low", True), (5, "e", "low", True),
    ]


def test_alert_changes(spark):
    df = spark.createDataFrame(
        [
            ("a", 1, at(1), "investigating", "first"), ("a", 2, at(2), "false_positive", ""),
            ("b", 1, at(1), "resolved", None), ("b", 2, at(5), "new", "again"), ("z", 1, at(1), "new", None),
        ],
        "alert_id string, seq long, at timestamp, status string, notes string",
    )
    states = log.alert_states(df)
    got = rows(states.select("alert_id", "status", "false_positive", "resolution_notes"), "alert_id")
    assert got == [("a", "false_positive", True, "first"), ("b", "new", False, "again"), ("z", "new", False, None)]
    alerts = spark.createDataFrame([("a", "new"), ("c", "new")], "alert_id string, status string")
    assert rows(log.apply_states(alerts, states.select("alert_id", "status")), "alert_id") == [("a", "false_positive"), ("c", "new")]
    assert {r[0] for r in log.unknown_alerts(df, alerts).select("alert_id").collect()} == {"b", "z"}


def test_indicator_changes(spark):
    ddl = (
        "seq long, at timestamp, op string, ioc_type string, value string, threat_type string,"
        " confidence double, severity string, source string, is_active boolean"
    )
    df = spark.createDataFrame(
        [
            (1, at(1), "seen", "ip", "x", "c2", None, "high", None, None),
            (2, at(2), "seen", "ip", "x", "other", 0.9, "low", "feed", None),
            (3, at(3), "deactivate", "ip", "x", None, None, None, None, None),
            (1, at(1), "seen", "ip", "y", None, None, None, "feed", None),
            (2, at(9), "deactivate", "ip", "y", None, None, None, None, None),
            (3, at(9), "seen", "ip", "y", None, None, None, None, None),
            (1, at(1), "deactivate", "ip", "never seen", None, None, None, None, None),
            (1, at(1), "seen", None, "no type", None, None, None, "feed", None),
        ],
        ddl,
    )
    got = log.current_iocs(df).select(
        "value", "threat_type", "severity", "source", "confidence", "is_active",
        F.unix_seconds("last_seen").alias("l") - 1_704_067_200,
    )
    assert rows(got, "value") == [
        ("x", "c2", "high", "manual", 0.9, False, 2), ("y", None, None, "feed", 0.5, True, 9),
    ]
    counts = reports.ioc_statistics(log.current_iocs(df)).first().asDict()
    assert counts == {"total": 2, "active": 1, "active_ip": 1, "active_domain": 0, "active_hash": 0, "active_url": 0}


def test_registry(spark):
    df = spark.createDataFrame([("f", 1, "a"), ("f", 2, "b"), ("s", 1, "c")], "model_type string, seq long, name string")
    assert rows(log.registry(df).select("name", "is_active"), "name") == [("a", False), ("b", True), ("c", True)]
    assert rows(log.active_models(df).select("model_type", "name"), "model_type") == [("f", "b"), ("s", "c")]


def alerts(spark, data):
    return spark.createDataFrame(
        [(f"a{i}", at(t), k, s, x) for i, (t, k, s, x) in enumerate(data)],
        "alert_id string, created_at timestamp, entity string, severity string, text string",
    )


def test_dedup_and_incidents(spark, way):
    df = alerts(spark, [
        (0, "h", "low", "login failed for bob"), (300, "h", "critical", "login failed for bob"),
        (601, "h", "low", "login failed for bob"), (602, "g", "low", "x"), (603, "h", "low", "something else"),
    ])
    got = dedup.alert_groups(df, ["entity"], "created_at", "alert_id")
    assert rows(got.select("alert_id", "group_no", "is_duplicate"), "alert_id") == [
        ("a0", 1, False), ("a1", 1, True), ("a2", 2, False), ("a3", 1, False), ("a4", 2, True),
    ]
    similar = dedup.alert_groups(df, ["entity"], "created_at", "alert_id", text="text")
    assert rows(similar.select("alert_id", "is_duplicate"), "alert_id")[4] == ("a4", False)
    links = dedup.incident_links(got, ["entity"])
    table = dedup.incidents(links, "created_at")
    assert rows(table.select("n_alerts", "severity", "status"), "n_alerts", "severity") == [
        (1, "low", "open"), (2, "critical", "open"), (2, "low", "open"),
    ]


def test_pages_do_not_overlap(spark):
    df = events(spark, [{"t": 1.0, "event_id": i} for i in range(25)])
    pages = [reports.page(df, "timestamp", "event_id", 10, o, event_type="network") for o in (0, 10, 20)]
    ids = [r["event_id"] for p in pages for r in p.collect()]
    assert ids == list(range(24, -1, -1))
    assert reports.page(df, "timestamp", "event_id", event_type="host").count() == 0


def test_statistics(spark):
    ev = events(spark, [{}, {}]).unionByName(events(spark, [{}], "host"))
    al = spark.createDataFrame([("new", "high"), ("false_positive", "low")], "status string, severity string")
    stats = reports.alert_statistics(al).first().asDict()
    assert (stats["total"], stats["status_new"], stats["status_false_positive"], stats["severity_low"]) == (2, 1, 1, 1)
    assert rows(reports.event_counts(ev), "event_type") == [("host", 1), ("network", 2), ("total", 3)]
    run = reports.pipeline_report(ev, al).first()
    assert run["ingestion"].asDict() == {"network": 2, "host": 1, "total": 3}
    assert run["detection"]["alerts_generated"] == 2 and run["detection"]["high"] == 1
    empty = reports.detection_statistics(ev.where("false"), al.where("false")).first()
    assert tuple(empty) == (0, 0, 0, 0, 0, 0)


def test_lookups(spark):
    ev = events(spark, [{"src_ip": "1.1.1.1", "dst_ip": "2.2.2.2"}, {"src_ip": "2.2.2.2"}, {}])
    iocs = spark.createDataFrame(
        [("ip", "1.1.1.1", "c2", 0.4, "low", True), ("ip", "2.2.2.2", "bot", 0.9, "low", True),
         ("domain", "2.2.2.2", "x", 1.0, "low", True), ("ip", "3.3.3.3", "x", 1.0, "low", False)],
        "ioc_type string, value string, threat_type string, confidence double, severity string, is_active boolean",
    )
    hits = lookups.ioc_hits(ev, "event_id", {"src_ip": "ip", "dst_ip": "ip"}, iocs)
    assert rows(hits.select("event_id", "field"), "event_id", "field") == [(0, "dst_ip"), (0, "src_ip"), (1, "src_ip")]
    al = spark.createDataFrame([("a", 0, None), ("b", 2, None)], "alert_id string, event_id long, threat_intel string")
    intel = lookups.with_threat_intel(al, hits)
    got = rows(intel.select("alert_id", F.get_json_object("threat_intel", "$.threat_type").alias("t")), "alert_id")
    assert got == [("a", "bot"), ("b", None)]


def test_comments_keep_quiet_alerts(spark):
    al = spark.createDataFrame([("a",), ("b",)], "alert_id string")
    comments = spark.createDataFrame(
        [("a", "x", str(i), at(i)) for i in range(40)], "alert_id string, author string, comment string, created_at timestamp"
    )
    got = lookups.alerts_with_comments(al, comments)
    assert rows(got.groupBy("alert_id").agg(F.count("comment")), "alert_id") == [("a", 40), ("b", 0)]


def test_fusion_bands(spark):
    df = spark.createDataFrame(
        [(1, "signature", 1.0), (1, "signature", 0.2), (1, "anomaly", 1.0), (2, "anomaly", 1.0), (3, "signature", 0.5)],
        "event_id long, detection_type string, confidence_score double",
    )
    got = fused_scores(df).select("event_id", F.round("fusion_score", 6), "severity")
    assert rows(got, "event_id") == [(1, 1.0, "critical"), (2, 0.3, "low"), (3, 0.35, "low")]


def test_mean_score_ignores_missing(spark):
    df = spark.sql("select map('a', 0.5D, 'b', cast(null as double)) m union all select map('a', cast(null as double))")
    assert [r[0] for r in df.select(mean_score(F.col("m"))).collect()] == [0.5, None]


def test_comments_repeat_no_alert_per_task(spark):
    """The side that Spark may broadcast holds every alert once."""
    from tests.plans import broadcast_rows

    al = spark.range(2000).select(F.col("id").cast("string").alias("alert_id"), F.col("id").alias("event_id"))
    comments = spark.range(4000).select(
        (F.col("id") % 5).cast("string").alias("alert_id"), F.col("id").cast("string").alias("author"),
        F.col("id").cast("string").alias("comment"), F.timestamp_seconds("id").alias("created_at"),
    )
    got = lookups.alerts_with_comments(al, comments)
    assert got.count() == 4000 + 1995
    assert broadcast_rows(got) <= 2000
