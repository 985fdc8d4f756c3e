"""Streams against the batch definition."""

import os

import pytest
from helpers import events, rows
from pyspark.sql import functions as F

from palisade.operators.features import flow_columns, host_features
from palisade.plans.detect import detect
from palisade.rules.model import Condition, Rule
from palisade.schemas import EVENT_SCHEMA
from palisade.streaming.detect_stream import (
    alert_writer,
    flow_state_writer,
    latest,
    read_event_files,
    start_detection,
    start_flow_statistics,
    start_trailing,
    windowed_counts,
)
from palisade.streaming.state import Bounds, refused

RULES = [
    Rule("burst", "", "threshold", "", "high", "network", (Condition("dst_port", "equals", value=22),),
         threshold=3, time_window_seconds=20, confidence=0.5, signature_id=1),
    Rule("port scan", "", "threshold", "", "high", "network", threshold=3, time_window_seconds=15, signature_id=2),
    Rule("telnet", "", "pattern", "", "low", "network", (Condition("dst_port", "equals", value=23),), signature_id=3),
]


def now():
    return F.lit("2024-02-01").cast("timestamp")


@pytest.fixture(scope="module")
def table(spark):
    data = [
        {"event_id": i, "t": float(i * 7 % 61) + i, "src_ip": "ab"[i % 5 == 0], "dst_ip": "z", "src_port": 1,
         "dst_port": [22, 22, 23, 80, 443][i % 5], "packets_sent": i, "bytes_sent": 10 * i}
        for i in range(90)
    ]
    return events(spark, data)


def slices(table):
    time = F.unix_seconds("timestamp") - 1_704_067_200
    for low, high in ((0, 40), (40, 41), (41, 90), (90, 1000)):
        yield table.where((time >= low) & (time < high))


def run(spark, table, inbox, start):
    for part in slices(table):
        part.write.mode("append").parquet(inbox)
        start(read_event_files(spark, inbox, EVENT_SCHEMA)).awaitTermination()


def test_stream_alerts_equal_batch(spark, table, tmp_path, way):
    paths = [str(tmp_path / x) for x in ("alerts", "state", "checkpoint")]
    run(spark, table, str(tmp_path / "in"), lambda s: start_detection(s, RULES, *paths, now(), once=True))
    stored = spark.read.parquet(paths[0])
    keep = ["alert_id", "event_id", "title", "confidence_score", "matched_rules"]
    want = rows(detect(table, RULES, now()).select(*keep), "alert_id")
    assert rows(stored.select(*keep), "alert_id") == want and len(want) > 20


def test_host_behaviour_on_a_stream(spark, tmp_path):
    data = [
        {"event_id": i, "t": float(i * 11 % 97), "hostname": "hg"[i % 3 == 0], "username": "u",
         "process_name": "p" if i % 2 else None, "command_line": "c" if i % 5 else ""}
        for i in range(60)
    ]
    hosts = events(spark, data, "host")
    paths = [str(tmp_path / x) for x in ("out", "state", "checkpoint")]
    run(spark, hosts, str(tmp_path / "in"), lambda s: start_trailing(s, host_features, 300, *paths, once=True))
    keep = ["event_id", "process_spawn_rate", "login_frequency", "command_execution_rate"]
    assert rows(spark.read.parquet(paths[0]).select(*keep), "event_id") == rows(host_features(hosts).select(*keep), "event_id")


def test_repeated_batch_changes_nothing(spark, table, tmp_path):
    parts = list(slices(table))
    writer = alert_writer(RULES, str(tmp_path / "a"), str(tmp_path / "s"), now())
    for number, part in enumerate(parts[:2]):
        writer(part, number)
    one = rows(spark.read.parquet(str(tmp_path / "a")).select("alert_id"), "alert_id")
    writer(parts[1], 1)
    assert rows(spark.read.parquet(str(tmp_path / "a")).select("alert_id"), "alert_id") == one


def test_stream_flows_equal_batch(spark, table, tmp_path):
    paths = [str(tmp_path / x) for x in ("out", "state", "checkpoint")]
    run(spark, table, str(tmp_path / "in"), lambda s: start_flow_statistics(s, *paths, 10_000, once=True))
    keep = ["event_id", "flow_duration", "packets_per_second", "bytes_per_second"]
    assert rows(spark.read.parquet(paths[0]).select(*keep), "event_id") == rows(flow_columns(table).select(*keep), "event_id")


def test_idle_flows_are_forgotten(spark, tmp_path):
    flow = {"src_ip": "a", "dst_ip": "b", "src_port": 1, "dst_port": 2, "packets_sent": 1, "bytes_sent": 1}
    table = events(spark, [{**flow, "event_id": 1, "t": 0.0}, {"event_id": 2, "t": 40.5, "src_ip": "q"},
                           {**flow, "event_id": 3, "t": 95.0}])
    paths = [str(tmp_path / x) for x in ("out", "state", "checkpoint")]
    bounds = Bounds(late_seconds=0)
    # A quarter of an hour apart, so that what came before is settled.
    writer = flow_state_writer(paths[0], paths[1], 30, bounds)
    for number, event in enumerate((1, 2, 3)):
        late = F.expr(f"timestamp + INTERVAL {15 * number} MINUTES")
        writer(table.where(F.col("event_id") == event).withColumn("timestamp", late), number)
    got = rows(spark.read.parquet(paths[0]).select("event_id", "flow_duration"), "event_id")
    assert got == [(1, None), (2, None), (3, None)]


def shuffled(table, future=True):
    part = F.pmod(F.xxhash64("event_id"), F.lit(4))
    for k in range(4):
        rows_ = table.where(part == k)
        if future and k == 0:
            far = table.limit(1).withColumn("event_id", F.lit(-1).cast("long")).withColumn(
                "timestamp", F.lit("2099-01-01").cast("timestamp"))
            rows_ = rows_.unionByName(far)
        yield rows_


def test_any_order_and_a_wrong_clock(spark, table, tmp_path, way):
    out, state = str(tmp_path / "a"), str(tmp_path / "s")
    writer = alert_writer(RULES, out, state, now())
    parts = list(shuffled(table))
    for number, part in enumerate(parts):
        writer(part, number)
    writer(parts[3], 3)  # a repeated batch
    keep = ["alert_id", "event_id", "title", "confidence_score", "matched_rules"]
    want = rows(detect(table, RULES, now()).select(*keep), "alert_id")
    assert rows(latest(spark.read.parquet(out), "alert_id").select(*keep), "alert_id") == want
    assert rows(refused(spark, state), "reason") == [("future", 1)]


def test_flows_in_any_order(spark, table, tmp_path):
    out, state = str(tmp_path / "a"), str(tmp_path / "s")
    writer = flow_state_writer(out, state, 10_000)
    for number, part in enumerate(shuffled(table)):
        writer(part, number)
    keep = ["event_id", "flow_duration", "packets_per_second", "bytes_per_second"]
    got = latest(spark.read.parquet(out), "event_id").select(*keep)
    assert rows(got, "event_id") == rows(flow_columns(table).select(*keep), "event_id")


def test_late_rows_are_set_aside_and_old_spans_go(spark, tmp_path):
    out, state = str(tmp_path / "a"), str(tmp_path / "s")
    writer = alert_writer(RULES, out, state, now(), Bounds(late_seconds=60))
    spans = []
    for number in range(8):
        data = [{"event_id": 10 * number + i, "t": 600.0 * number + i, "src_ip": "a", "dst_port": 22} for i in range(4)]
        if number == 3:
            data.append({"event_id": 999, "t": 5.0, "src_ip": "a", "dst_port": 22})
        writer(events(spark, data), number)
        spans.append(len([x for x in os.listdir(f"{state}/rows") if x.startswith("span=")]))
    assert rows(refused(spark, state), "reason") == [("late", 1)]
    assert max(spans) <= 3
    assert sorted(r["event_id"] % 10 for r in spark.read.parquet(out).collect()) == sorted([2, 3] * 8)


def test_windowed_counts(spark, table, tmp_path):
    def start(stream):
        def store(batch, number):
            batch.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={number}"))

        counts = windowed_counts(stream, ["src_ip"], "20 seconds", None, "1 hour")
        return counts.writeStream.outputMode("update").foreachBatch(store).option(
            "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()

    run(spark, table, str(tmp_path / "in"), start)
    out = spark.read.parquet(str(tmp_path / "out"))
    got = out.groupBy("src_ip", F.unix_seconds("start").alias("s")).agg(F.max("n_events"))
    want = table.groupBy("src_ip", (F.unix_seconds("timestamp") - F.unix_seconds("timestamp") % 20).alias("s")).count()
    assert rows(got, "src_ip", "s") == rows(want, "src_ip", "s")
