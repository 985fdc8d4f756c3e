"""Compaction of change logs, partial aggregates, and the alert sink."""

import os
import random

import contract.reports
import pytest
from __spark_entry__ import queries
from helpers import events, rows
from pyspark.sql import functions as F

from palisade.operators import changelog as log
from palisade.operators import reports, rollups
from palisade.plans.detect import detect
from palisade.rules.model import Condition, Rule
from palisade.schemas import ALERT_SCHEMA
from palisade.sources import sinks

PORTS = Rule("port", "", "pattern", "", "high", "network", (Condition("dst_port", "range", min=100),), signature_id=1)


def rule_changes(draw, n):
    out = [(draw.randrange(8), i, draw.choice(["add", "add", "update", "enable", "disable", "delete" if i % 19 == 0 else "update"]),
            draw.choice([None, True, False]), draw.choice([None, f"name{i}"]), draw.choice([None, f"text{i}"])) for i in range(n)]
    return out, "signature_id long, seq long, op string, enabled boolean, name string, text string"


def state_changes(draw, n):
    out = [(f"a{draw.randrange(9)}", i, draw.choice(["new", "investigating", "resolved", "false_positive"]), draw.choice([None, "", f"n{i}"])) for i in range(n)]
    return out, "alert_id string, seq long, status string, notes string"


def sightings(draw, n):
    out = [(i, draw.choice(["seen", "seen", "deactivate"]), draw.choice([None, "ip", "url"]), draw.choice([None, "x", "y", "z"]),
            draw.choice([None, "c2"]), draw.choice([None, "low"]), draw.choice([None, "d"]), draw.choice([None, "feed"]),
            draw.choice([None, 0.1, 0.9]), draw.choice([None, True, False]), draw.randrange(10**6)) for i in range(n)]
    return out, ("seq long, op string, ioc_type string, value string, threat_type string, severity string, description string,"
                 " source string, confidence double, is_active boolean, t long")


LOGS = {
    "rules": (rule_changes, log.RULE_KEYS, None, None),
    "states": (state_changes, log.STATE_KEYS, None, log.alert_states),
    "iocs": (sightings, log.IOC_KEYS, None, log.current_iocs),
}


@pytest.mark.parametrize("name", list(LOGS))
@pytest.mark.parametrize("seed", [1, 2])
def test_a_compacted_log_folds_to_the_same(spark, tmp_path, name, seed):
    make, keys, _, fold = LOGS[name]
    data, schema = make(random.Random(seed), 400)
    table = spark.createDataFrame(data, schema)
    if name == "states":
        table = table.withColumn("at", F.timestamp_seconds("seq"))
    if name == "iocs":
        table = table.withColumn("at", F.timestamp_seconds("t")).drop("t")
    wanted = {"rules": lambda: log.rule_witnesses(["name", "text"]), "states": log.state_witnesses, "iocs": log.ioc_witnesses}[name]()
    fold = fold or (lambda changes: log.current_rules(changes, ["name", "text"]))
    path = str(tmp_path)
    order = F.pmod(F.xxhash64("seq"), F.lit(4))  # changes may come late
    assert log.read_changes(spark, path, table.schema).count() == 0
    for batch in range(4):
        log.append_changes(table.where(order == batch), path, batch)
        log.append_changes(table.where(order == batch), path, batch)  # repeated
        if batch < 3:
            assert log.compact(spark, path, table.schema, keys, wanted) == batch
    short = log.read_changes(spark, path, table.schema)
    assert short.count() < 300
    names = sorted(fold(table).columns)
    assert rows(fold(short).select(*names), *names) == rows(fold(table).select(*names), *names)
    assert rows(fold(log.witnesses(table, keys, wanted)).select(*names), *names) == rows(fold(table).select(*names), *names)


def test_partials_of_runs_make_the_dashboard(spark, tmp_path):
    draw = random.Random(3)
    data = [{"event_id": i, "t": 40_000.0 * draw.random() * 9, "src_ip": f"10.0.0.{draw.randrange(40)}", "dst_port": draw.randrange(300),
             "bytes_sent": i} for i in range(300)]
    net, host = events(spark, data), events(spark, [{**d, "event_id": 1000 + d["event_id"]} for d in data[:50]], "host")
    every = net.unionByName(host)
    alerts = detect(every, [PORTS], F.col("timestamp")).withColumn("status", F.when(F.col("event_id") % 3 == 0, "resolved").otherwise("new"))
    rules = spark.createDataFrame([(True,), (False,)], "enabled boolean")
    iocs = spark.createDataFrame([("ip", True), ("url", False)], "ioc_type string, is_active boolean")
    path = str(tmp_path)
    for run in (0, 1, 1, 2):
        part = F.col("event_id") % 3 == run
        rollups.store(path, run, rollups.event_partials(every.where(part)), rollups.alert_partials(alerts.where(part)))
    stored = rollups.read(spark, path)
    assert rows(rollups.dashboard(stored, rules, iocs), "section", "metric") == rows(
        reports.dashboard(every, alerts, rules, iocs), "section", "metric")
    want = every.groupBy(F.to_date("timestamp").alias("day")).agg(
        F.count(F.lit(1)), F.sum("bytes_sent"), F.max("timestamp"), F.countDistinct("src_ip"))
    assert rows(rollups.daily_totals(stored), "day") == rows(want, "day")
    empty = rollups.dashboard(stored.limit(0), rules, iocs)
    assert {r["value"] for r in empty.where("section in ('events', 'alerts')").collect()} == {0}


def test_alerts_are_stored_by_day_of_their_event(spark, tmp_path):
    path = str(tmp_path / "alerts")
    table = events(spark, [{"event_id": i, "t": 86_400.0 * (i // 2), "dst_port": 200} for i in range(8)])
    sinks.write_alerts(detect(table, [PORTS], F.lit("2024-05-01").cast("timestamp")), path)
    # A later run over two of the days, another day of creation.
    again = table.where("event_id in (2, 3, 4)").unionByName(events(spark, [{"event_id": 50, "t": 86_401.0, "dst_port": 200}]))
    sinks.write_alerts(detect(again, [PORTS], F.lit("2024-06-01").cast("timestamp")), path)
    stored = spark.read.parquet(path)
    assert rows(stored.groupBy("alert_date").count().select(F.col("alert_date").cast("string"), "count"), "alert_date") == [
        ("2024-01-01", 2), ("2024-01-02", 3), ("2024-01-03", 2), ("2024-01-04", 2)]
    assert stored.where("event_time is null").count() == 0 and set(ALERT_SCHEMA.names) < set(stored.columns)
    assert len(os.listdir(f"{path}/alert_date=2024-01-01")) < len(os.listdir(f"{path}/alert_date=2024-01-02"))
    undated = detect(table, [PORTS], F.lit("2024-06-01").cast("timestamp")).withColumn("event_time", F.lit(None).cast("timestamp"))
    sinks.write_alerts(undated.withColumn("alert_id", F.lit("x")).limit(1), path)
    assert spark.read.parquet(path).where("alert_date = '2024-06-01'").count() == 1


def test_similar_texts_like_brute_force(spark):
    from palisade.operators.similarity import similar_classes

    draw = random.Random(5)
    words = ["a", "b", "c", "d", "e", "f", "g", "h", "10.0.0.1", "x.y"]
    texts = [" ".join(draw.sample(words, draw.randrange(1, 9))).upper() + draw.choice(["", " a", "!!", " common"]) for _ in range(150)]
    texts += [None, "", " ,; ", texts[0], texts[0] + " " + texts[0]]
    for least in (0.5, 0.8, 1.0):
        got = {r["i"]: r for r in similar_classes(
            spark.createDataFrame(list(enumerate(texts)), "i long, t string"), "i", F.col("t"), least).collect()}
        sets = [frozenset(w for w in "".join(ch if ch.isalnum() or ch == "." else " " for ch in (t or "").lower()).split()) for t in texts]
        distinct = list(dict.fromkeys(sets))
        near = {s: {o for o in distinct if o != s and s and len(s & o) >= least * len(s | o) - 1e-9} for s in distinct}
        group = {}
        for s in distinct:
            if s not in group:
                todo = [s]
                while todo:
                    x = todo.pop()
                    if x not in group:
                        group[x] = s
                        todo += near[x]
        assert all(got[i]["n_similar"] == len(near[s]) for i, s in enumerate(sets))
        assert {(i, j) for i in got for j in got if got[i]["class_id"] == got[j]["class_id"]} == {
            (i, j) for i in got for j in got if group[sets[i]] == group[sets[j]]}


@pytest.mark.parametrize("name", ["dashboard_long", "dashboard_incremental"])
def test_dashboards_read_the_use_of_rules_from_stored_alerts(spark, name, monkeypatch):
    folder = "/root/testdata/sf0.001"
    want = rows(queries()["rule_stats"](spark, folder))[0]

    def again(*_):
        raise AssertionError("all rules are matched again")

    monkeypatch.setattr(contract.reports, "match_events", again)
    got = queries()[name](spark, folder).where("section = 'signatures'").select("metric", "value")
    assert dict(rows(got)) == {"enabled": want[0], "total": want[1]}


def test_a_few_folders_are_written_without_a_sort(spark, tmp_path):
    """Rows of up to four folders keep their order, and any number of folders is written whole."""
    for n in (3, 11):
        df = spark.range(0, 1000, 1, 2).select("id", (F.col("id") * 7 % n).alias("part"))
        df.write.partitionBy("part").parquet(f"{tmp_path}/{n}")
        back = spark.read.parquet(f"{tmp_path}/{n}")
        assert rows(back.select("id", "part"), "id") == [(i, i * 7 % n) for i in range(1000)]
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "4"
