"""Keyed state of streams: thresholds and flows in any order, corrections, timers."""

import random

import numpy as np
import pytest
from helpers import at, events, rows
from pyspark.sql import functions as F
from test_streaming import RULES, now, shuffled, table  # noqa: F401

from palisade.operators.features import flow_columns
from palisade.plans.detect import detect
from palisade.schemas import EVENT_SCHEMA
from palisade.streaming.detect_stream import latest, read_event_files
from palisade.streaming.keyed import (
    counts_of_rows,
    counts_of_values,
    in_time,
    start_keyed_detection,
    start_keyed_flows,
    start_refused,
)
from palisade.streaming.state import Bounds

KEEP = ["alert_id", "event_id", "title", "confidence_score", "matched_rules"]
FLOWS = ["event_id", "flow_duration", "packets_per_second", "bytes_per_second"]


def run(spark, parts, inbox, start):
    """Land each part and run the stream until it has caught up; the progress after each."""
    progress = []
    for part in parts:
        part.write.mode("append").parquet(inbox)
        query = start(read_event_files(spark, inbox, EVENT_SCHEMA))
        query.awaitTermination()
        progress.append(query.recentProgress)
    return progress


@pytest.mark.parametrize("seed", range(6))
def test_counts(seed):
    draw = random.Random(seed)
    us = np.array(sorted(draw.randrange(60) for _ in range(draw.randrange(40))), np.int64)
    value = np.array([draw.randrange(5) for _ in us], np.int64)
    width = draw.randrange(1, 20)
    n, d = counts_of_rows(us, width), counts_of_values(us, value, width)
    for i, t in enumerate(us.tolist()):
        assert n[i] == sum(t - width < s for s in us[: i + 1].tolist())
        assert d[i] == len({v for s, v in zip(us.tolist(), value.tolist()) if t - width < s <= t and v})


@pytest.mark.parametrize("rules", [RULES, RULES[:2], RULES[2:]])
def test_alerts_in_any_order_equal_batch(spark, table, tmp_path, rules):  # noqa: F811
    inbox, alerts, checkpoint, side, side_cp = (str(tmp_path / x) for x in "iacso")

    def both(stream):
        start_refused(stream, side, side_cp, once=True).awaitTermination()
        return start_keyed_detection(stream, rules, alerts, checkpoint, now(), once=True)

    undated = table.limit(1).select(*[F.lit(None).cast("timestamp").alias(c) if c == "timestamp" else c for c in table.columns])
    run(spark, [*shuffled(table), undated], inbox, both)
    want = rows(detect(table, rules, now()).select(*KEEP), "alert_id")
    assert rows(latest(spark.read.parquet(alerts), "alert_id", "version").select(*KEEP), "alert_id") == want
    assert sorted(r["reason"] for r in spark.read.parquet(side).collect()) == ["future", "undated"]


def test_a_late_row_corrects_what_came_before_it(spark, tmp_path):
    def part(*seconds):
        return events(spark, [{"event_id": int(t), "t": float(t), "src_ip": "a", "dst_port": 22} for t in seconds])

    inbox, alerts, checkpoint = (str(tmp_path / x) for x in "iac")
    bounds = Bounds(late_seconds=60)
    parts = [part(100, 105, 118), part(109), part(400), part(110), part(405, 410)]
    progress = run(
        spark, parts, inbox, lambda s: start_keyed_detection(s, RULES[:1], alerts, checkpoint, now(), once=True, bounds=bounds)
    )
    stored = spark.read.parquet(alerts)
    got = [(r["event_id"], r["version"], r["matched_rules"]) for r in stored.orderBy("event_id", "version").collect()]
    counts = [(i, v, int(m.split('"count":')[1].split(",")[0])) for i, v, m in got]
    # 109 comes late and raises 118 from 3 to 4; 110 comes too late, when 400 has been seen.
    assert counts == [(109, 2, 3), (118, 1, 3), (118, 2, 4), (410, 2, 3)]
    newest = latest(stored, "alert_id", "version")
    assert newest.count() == 3 and newest.where("event_id = 118").first()["confidence_score"] == pytest.approx(0.5 * 4 / 3)
    dropped = sum(s["numRowsDroppedByWatermark"] for run_ in progress for p in run_ for s in p["stateOperators"])
    assert dropped == 1
    # Slices are 80 seconds long. The timer of the first one has cleared it, the last has two entries and its timer.
    assert progress[2][-1]["stateOperators"][0]["numRowsTotal"] <= progress[0][-1]["stateOperators"][0]["numRowsTotal"]


def test_state_does_not_grow(spark, tmp_path):
    inbox, alerts, checkpoint = (str(tmp_path / x) for x in "iac")
    parts = [
        events(spark, [{"event_id": 10 * k + i, "t": 600.0 * k + i, "src_ip": "a", "dst_port": 22} for i in range(4)])
        for k in range(6)
    ]
    progress = run(
        spark, parts, inbox,
        lambda s: start_keyed_detection(s, RULES[:1], alerts, checkpoint, now(), once=True, bounds=Bounds(late_seconds=60)),
    )
    held = [p[-1]["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert max(held[1:]) <= held[0]
    assert sorted(r["event_id"] % 10 for r in spark.read.parquet(alerts).collect()) == sorted([2, 3] * 6)


def test_flows_in_any_order_equal_batch(spark, table, tmp_path):  # noqa: F811
    inbox, out, checkpoint = (str(tmp_path / x) for x in "ioc")
    run(spark, shuffled(table), inbox, lambda s: start_keyed_flows(s, out, checkpoint, 10_000, once=True))
    got = latest(spark.read.parquet(out), "event_id", "version").select(*FLOWS)
    assert rows(got, "event_id") == rows(flow_columns(table).select(*FLOWS), "event_id")


def test_settled_flows_go_on_and_idle_ones_are_forgotten(spark, tmp_path):
    flow = {"src_ip": "a", "dst_ip": "b", "src_port": 1, "dst_port": 2, "packets_sent": 3, "bytes_sent": 7}
    other = {"src_ip": "q", "packets_sent": 1, "bytes_sent": 1}
    times = [(1, 0.0, flow), (2, 40.0, other), (3, 50.0, flow), (4, 45.0, flow), (5, 90.0, other), (6, 91.0, flow), (7, 400.0, other),
             (8, 401.0, other), (9, 402.0, flow), (10, 403.0, flow)]
    table_ = events(spark, [{**f, "event_id": i, "t": t} for i, t, f in times])
    inbox, out, checkpoint = (str(tmp_path / x) for x in "ioc")
    parts = [table_.where(F.col("event_id") == i) for i, *_ in times]
    run(spark, parts, inbox, lambda s: start_keyed_flows(s, out, checkpoint, 100, once=True, bounds=Bounds(late_seconds=20)))
    got = {r["event_id"]: (r["flow_duration"], r["packets_per_second"]) for r in latest(
        spark.read.parquet(out), "event_id", "version").collect()}
    # 4 comes after 3, and 3 is corrected; 6 goes on from totals; at 400 the flow is forgotten, and 9 begins it anew.
    assert got[1] == (None, None) and got[4] == (45.0, 3 / 45) and got[3] == (50.0, 6 / 50) and got[6] == (91.0, 9 / 91)
    assert got[9] == (None, None) and got[10] == (1.0, 3.0)
    assert got[2] == (None, None) and got[5] == (50.0, 1 / 50) and got[8][0] in (1.0, 361.0)


def test_bounds_of_time(spark):
    one = events(spark, [{"event_id": 1, "t": 0.0}, {"event_id": 2, "t": 301.0}, {"event_id": 3, "t": 300.0}])
    clock = F.lit(at(0.0)).cast("timestamp")
    assert rows(in_time(one, now=clock).select("event_id"), "event_id") == [(1,), (3,)]


def test_flows_share_keys(spark, tmp_path):
    """Every key costs calls in every batch, so there are no more keys for more flows."""
    table_ = events(spark, [{"event_id": i, "t": float(i), "src_ip": str(i % 200), "packets_sent": i} for i in range(400)])
    inbox, out, checkpoint = (str(tmp_path / x) for x in "ioc")
    parts = [table_.where("event_id % 2 = 0"), table_.where("event_id % 2 = 1")]
    progress = run(spark, parts, inbox, lambda s: start_keyed_flows(s, out, checkpoint, 10_000, once=True, buckets=2))
    got = latest(spark.read.parquet(out), "event_id", "version").select(*FLOWS)
    assert rows(got, "event_id") == rows(flow_columns(table_).select(*FLOWS), "event_id")
    # For each key its totals, its timer in two orders, and two pieces of rows with their count.
    assert max(s["numRowsTotal"] for p in progress[-1] for s in p["stateOperators"]) <= 2 * 6


def test_an_idle_flow_is_forgotten_beside_others(spark, tmp_path):
    flow, other = ({"src_ip": a, "packets_sent": 3, "bytes_sent": 7} for a in "ab")
    times = [(1, 0.0, flow), (2, 10.0, other), (3, 90.0, other), (4, 180.0, other), (5, 185.0, other), (6, 190.0, flow), (7, 191.0, flow), (8, 192.0, other)]
    table_ = events(spark, [{**f, "event_id": i, "t": t} for i, t, f in times])
    inbox, out, checkpoint = (str(tmp_path / x) for x in "ioc")
    parts = [table_.where(F.col("event_id") == i) for i, *_ in times]
    bounds = Bounds(late_seconds=20)
    run(spark, parts, inbox, lambda s: start_keyed_flows(s, out, checkpoint, 100, once=True, bounds=bounds, buckets=1))
    stored = latest(spark.read.parquet(out), "event_id", "version")
    got = {r["event_id"]: r["flow_duration"] for r in stored.collect()}
    assert got == {1: None, 2: None, 3: 80.0, 4: 170.0, 5: 175.0, 6: None, 7: 1.0, 8: 182.0}
