"""Rule compiling and matching."""

from dataclasses import replace

import pytest
from helpers import events, rows
from pyspark.sql import functions as F

from palisade.operators.alerts import new_alerts_only, signature_alerts
from palisade.plans.detect import detect, detect_and_store
from palisade.rules.catalog import DEFAULT_RULES
from palisade.rules.compile import condition_column, details_json
from palisade.operators import joins
from palisade.rules import matching
from palisade.rules.matching import (
    ioc_rule_matches,
    match_events,
    pattern_matches,
    stateless_matches,
    threshold_matches,
)
from palisade.rules.model import Condition, Rule, rule_from_dict, rules_frame, rules_from_frame
from palisade.schemas import ALERT_SCHEMA

def now():
    return F.lit("2024-02-01").cast("timestamp")


def pattern(*conditions, **kw):
    return Rule("p", "", "pattern", "", "low", conditions=conditions, signature_id=1, **kw)


def hit_ids(df, rule):
    return [r[0] for r in rows(pattern_matches(df, [rule]).select("event_id"), "event_id")]


def test_every_condition_type(spark):
    df = events(spark, [
        {"dst_port": 22, "protocol": "TCP", "bytes_sent": 5, "src_ip": "10.0.0.1"},
        {"dst_port": 23, "protocol": "tcp", "bytes_sent": 10, "src_ip": "11.0.0.1"},
        {"dst_port": None, "protocol": None, "bytes_sent": None, "src_ip": None},
    ])
    assert hit_ids(df, pattern(Condition("dst_port", "equals", value=22))) == [0]
    assert hit_ids(df, pattern(Condition("dst_port", "equals", value="22"))) == [0]
    assert hit_ids(df, pattern(Condition("dst_port", "equals", value="ssh"))) == []
    assert hit_ids(df, pattern(Condition("dst_port", "in", values=(23, 99)))) == [1]
    assert hit_ids(df, pattern(Condition("bytes_sent", "range", min=5, max=9))) == [0]
    assert hit_ids(df, pattern(Condition("bytes_sent", "range", min=10))) == [1]
    assert hit_ids(df, pattern(Condition("src_ip", "range", min=1))) == []
    assert hit_ids(df, pattern(Condition("protocol", "contains", value="TC"))) == [0]
    assert hit_ids(df, pattern(Condition("protocol", "regex", pattern="^tc"))) == [0, 1]
    assert hit_ids(df, pattern(Condition("dst_port", "regex", pattern="^2"))) == [0, 1]
    both = pattern(Condition("dst_port", "range", min=1), Condition("src_ip", "regex", pattern="^11"))
    assert hit_ids(df, both) == [1]


def test_rules_that_match_nothing(spark):
    df = events(spark, [{"dst_port": 22}])
    port = Condition("dst_port", "equals", value=22)
    assert hit_ids(df, pattern()) == []
    assert hit_ids(df, pattern(port, enabled=False)) == []
    assert hit_ids(df, pattern(port, event_type="host")) == []
    assert hit_ids(df, pattern(port, event_type=None)) == [0]
    assert hit_ids(df, pattern(Condition("nothing", "equals", value=1))) == []
    with pytest.raises(ValueError, match="unknown condition"):
        condition_column(df, Condition("dst_port", "near", value=1))


def test_unknown_rule_type_warns(spark):
    df = events(spark, [{"dst_port": 22}])
    with pytest.warns(UserWarning, match="unknown type"):
        assert match_events(df, [replace(pattern(), rule_type="magic")]).count() == 0


def test_path_into_raw_json(spark):
    df = events(spark, [{"raw_data": '{"a": {"b": "x1"}}'}, {"raw_data": '{"a": {}}'}, {}])
    assert hit_ids(df, pattern(Condition("raw_data.a.b", "regex", pattern="^X"))) == [0]


def test_many_rules_go_into_several_arrays(spark):
    df = events(spark, [{"dst_port": p} for p in range(250)])
    many = [
        Rule(f"r{p}", "", "pattern", "", "low", conditions=(Condition("dst_port", "equals", value=p),),
             signature_id=p + 1)
        for p in range(250)
    ]
    assert rows(pattern_matches(df, many).select("event_id", "signature_id"), "event_id") == [
        (p, p + 1) for p in range(250)
    ]


@pytest.mark.parametrize("process, command, name", [
    ("PowerShell.exe", "powershell -ENC abc", "PowerShell Encoded Command"),
    ("x", "curl -s HTTP://h", "Suspicious Download via Command Line"),
    ("rsync", None, "Netcat Usage"),
    ("MIMIKATZ", None, "Mimikatz Credential Dumping"),
    ("x", "frombase64string(1)", "Base64 in Command Line"),
    ("x", "at /create", "Scheduled Task Creation"),
    ("x", "REG ADD HKLM runonce", "Registry Autorun Modification"),
    ("x", "vssadmin  delete all shadows", "Shadow Copy Deletion"),
])
def test_shipped_host_rules(spark, process, command, name):
    df = events(spark, [{"process_name": process, "command_line": command}], "host")
    alerts = detect(df, DEFAULT_RULES, now())
    assert [r["title"] for r in alerts.collect()] == [name]


def test_shipped_rule_near_misses(spark):
    df = events(spark, [
        {"process_name": "bash", "command_line": "schtasks /create /tn x"},
        {"process_name": "bash", "command_line": "wget ftp://x"},
        {"process_name": "cmd", "command_line": "powershell -enc"},
    ], "host")
    assert pattern_matches(df, DEFAULT_RULES).count() == 0


def test_ioc_rule(spark):
    rule = Rule("i", "", "ioc", "", "high", ioc_values=("1.2.3.4", "evil", "vil"), signature_id=9)
    net = events(spark, [
        {"src_ip": "1.2.3.4", "dst_ip": "1.2.3.4"}, {"src_ip": "1.2.3.5"}, {"dst_ip": "1.2.3.4"},
    ])
    assert rows(ioc_rule_matches(net, [rule]).select("event_id", "details"), "event_id") == [
        (0, '{"src_ip":"1.2.3.4","dst_ip":"1.2.3.4"}'), (2, '{"dst_ip":"1.2.3.4"}'),
    ]
    host = events(spark, [
        {"process_name": "evil", "command_line": "run evil now"}, {"process_name": "evilx"},
        {"command_line": "a.vil"}, {"command_line": ""},
    ], "host")
    assert rows(ioc_rule_matches(host, [rule]).select("event_id", "details"), "event_id") == [
        (0, '{"process_name":"evil","command_line":"vil"}'), (2, '{"command_line":"vil"}'),
    ]


def test_long_ioc_list(spark):
    values = tuple(f"bad{i}." for i in range(500)) + ("ad7", "9.9.9.9")
    rule = Rule("i", "", "ioc", "", "high", ioc_values=values, signature_id=9)
    df = events(spark, [
        {"command_line": "x bad7. y bad3. z"}, {"command_line": "bad5"}, {"command_line": None},
        {"command_line": "bad499.bad12."}, {"event_type": "network", "src_ip": "9.9.9.9"},
    ], "host")
    assert rows(ioc_rule_matches(df, [rule]).select("event_id", "details"), "event_id") == [
        (0, '{"command_line":"ad7"}'), (3, '{"command_line":"bad499."}'), (4, '{"src_ip":"9.9.9.9"}'),
    ]


def test_short_ioc_lists_are_sought_in_the_scan(spark, monkeypatch):
    values = ("evil", "", "vil", "cat /etc", "Evil ", "1.2.3.4")
    rules = [Rule("i", "", "ioc", "", "high", ioc_values=values, signature_id=9),
             Rule("j", "", "ioc", "", "low", "host", ioc_values=values[::-1], signature_id=10),
             Rule("k", "", "ioc", "", "low", "host", ioc_values=("no", "none"), signature_id=11)]
    commands = ["run evil now", "vi", "cat /etc/x evil", "Evil vil", "", None, "no 1.2.3.4", "none"]
    df = events(spark, [{"command_line": c, "process_name": "evil" if i % 3 == 0 else None} for i, c in enumerate(commands)]
                + [{"event_type": "network", "src_ip": "1.2.3.4", "command_line": "evil"}], "host")

    def found():
        return ioc_rule_matches(df, rules).select("event_id", "signature_id", "details")

    plan = found()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    got = rows(found(), "event_id", "signature_id")
    monkeypatch.setattr(matching, "FEW_VALUES", 0)
    assert "Join" in found()._jdf.queryExecution().executedPlan().toString()
    assert got and rows(found(), "event_id", "signature_id") == got


def threshold(name="t", n=3, seconds=10, conditions=(), key="src_ip", **kw):
    return Rule(name, "", "threshold", "", "high", "network", tuple(conditions), threshold=n,
                time_window_seconds=seconds, grouping_key=key, confidence=0.5, signature_id=4, **kw)


def test_threshold_counts_and_confidence(spark, way):
    df = events(spark, [
        {"t": 0.0, "src_ip": "a", "dst_port": 22}, {"t": 1.0, "src_ip": "a", "dst_port": 22},
        {"t": 1.0, "src_ip": "a", "dst_port": 80}, {"t": 2.0, "src_ip": "a", "dst_port": 22},
        {"t": 10.0, "src_ip": "a", "dst_port": 22}, {"t": 3.0, "src_ip": "b", "dst_port": 22},
        {"t": 3.0, "src_ip": "", "dst_port": 22}, {"t": 3.0, "src_ip": None, "dst_port": 22},
    ])
    rule = threshold(conditions=[Condition("dst_port", "equals", value=22)])
    got = rows(threshold_matches(df, [rule]).select("event_id", "confidence", "details"), "event_id")
    assert got == [
        (3, 0.5, '{"count":3,"threshold":3,"time_window":10,"grouping":"src_ip=a"}'),
        (4, 0.5, '{"count":3,"threshold":3,"time_window":10,"grouping":"src_ip=a"}'),
    ]
    low = threshold(n=1, conditions=[Condition("dst_port", "equals", value=22)])
    top = {r[0]: r[1] for r in rows(threshold_matches(df, [low]).select("event_id", "confidence"))}
    assert top[3] == 1.0 and top[0] == 0.5


def test_legacy_threshold(spark, way):
    df = events(spark, [{"t": float(100 * i), "src_ip": "a", "dst_port": i} for i in range(4)])
    rule = threshold(conditions=[Condition("dst_port", "equals", value=22)])
    got = rows(threshold_matches(df, [rule], legacy=True).select("event_id"), "event_id")
    assert got == [(0,), (1,)]
    scan = threshold(name="Port scan", n=2)
    assert rows(threshold_matches(df, [scan], legacy=True).select("event_id"), "event_id") == [(0,), (1,), (2,)]


def test_scan_counts_distinct_ports(spark, way):
    ports = [1, 1, 2, 0, None, 3]
    df = events(spark, [{"t": float(i), "src_ip": "a", "dst_port": p} for i, p in enumerate(ports)])
    got = threshold_matches(df, [threshold(name="a SCAN rule", n=2, seconds=4)])
    assert rows(got.select("event_id"), "event_id") == [(2,), (3,), (4,), (5,)]


def test_rows_in_any_order_give_the_same_alerts(spark):
    df = events(spark, [{"t": float(i % 7), "src_ip": "ab"[i % 2], "dst_port": 22} for i in range(40)])
    rule = [threshold(n=4, seconds=3, conditions=[Condition("dst_port", "equals", value=22)])]
    a = rows(match_events(df, rule), "event_id")
    assert a == rows(match_events(df.orderBy(F.rand(3)).repartition(5), rule), "event_id")
    assert len(a) > 0


def test_rule_table_round_trip(spark):
    back = rules_from_frame(rules_frame(spark, DEFAULT_RULES))
    assert [r.name for r in back] == [r.name for r in DEFAULT_RULES]
    df = events(spark, [{"dst_port": 23, "src_ip": "10.1.1.1", "bytes_sent": 20_000_000}, {"dst_port": 445, "src_ip": "172.16.0.1", "dst_ip": "192.168.0.1"}])
    one = rows(pattern_matches(df, DEFAULT_RULES).select("event_id", "signature_id"), "event_id", "signature_id")
    two = rows(pattern_matches(df, back).select("event_id", "signature_id"), "event_id", "signature_id")
    assert one == two == [(0, 4), (0, 7), (1, 5)]


def test_alerts_are_idempotent(spark):
    df = events(spark, [{"dst_port": 23}, {"dst_port": 23}])
    alerts = detect(df, DEFAULT_RULES, now())
    assert alerts.columns == ALERT_SCHEMA.names
    assert alerts.count() == 2
    assert new_alerts_only(detect(df, DEFAULT_RULES, now()), alerts).count() == 0
    one = alerts.orderBy("event_id").first()
    assert (one["title"], one["severity"], one["status"]) == ("Telnet Usage", "low", "new")
    assert one["matched_rules"] == '{"details":{"dst_port":"equals 23"}}'


def test_the_planner_measures_the_rules(spark):
    df = events(spark, [{"dst_port": 23}, {"dst_port": 23}])
    few = detect(df, DEFAULT_RULES, now())
    assert "BroadcastHashJoin [signature_id" in few._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    many = detect(df, DEFAULT_RULES, now())
    assert "SortMergeJoin [signature_id" in many._jdf.queryExecution().executedPlan().toString()
    assert rows(many.select("alert_id"), "alert_id") == rows(few.select("alert_id"), "alert_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_text_zero_groups_and_number_zero_does_not(spark):
    rule = Rule("Sudo", "", "threshold", "", "high", threshold=2, time_window_seconds=60, grouping_key="username", signature_id=1)
    df = events(spark, [{"event_type": "host", "username": u, "t": float(i)} for i, u in enumerate(["0", "0", "", "", None, None])])
    assert rows(threshold_matches(df, [rule]).select("event_id"), "event_id") == [(1,)]
    ports = Rule("Port", "", "threshold", "", "high", threshold=2, time_window_seconds=60, grouping_key="dst_port", signature_id=2)
    df = events(spark, [{"dst_port": p, "t": float(i)} for i, p in enumerate([0, 0, 5, 5, None, None])])
    assert rows(threshold_matches(df, [ports]).select("event_id"), "event_id") == [(3,)]


def test_two_port_rules_count_their_own_rows(spark):
    rules = [
        Rule(f"scan {p}", "", "threshold", "", "high", "network", (Condition("protocol", "equals", value=p),),
             threshold=2, time_window_seconds=60, signature_id=i)
        for i, p in enumerate(["TCP", "UDP"])
    ]
    data = [("TCP", 1), ("UDP", 1), ("UDP", 1), ("TCP", 2), ("UDP", 3)]
    df = events(spark, [{"protocol": p, "dst_port": d, "src_ip": "a", "t": float(i)} for i, (p, d) in enumerate(data)])
    got = rows(threshold_matches(df, rules).select("event_id", "signature_id"), "event_id")
    assert got == [(3, 0), (4, 1)]


def test_indicators_short_and_long(spark):
    values = ("su", "powershell", "shell", "zz", "power", "a")
    rule = Rule("i", "", "ioc", "", "high", ioc_values=values, signature_id=50)
    commands = ["xx powershell", "su", "zz su", "", None, "pow", "bash", "q", "powe"]
    df = events(spark, [{"event_type": "host", "command_line": c} for c in commands])
    got = dict(rows(ioc_rule_matches(df, [rule]).select("event_id", F.get_json_object("details", "$.command_line")), "event_id"))

    def last(text):
        return next((v for v in reversed(values) if text and v in text), None)

    assert got == {i: last(c) for i, c in enumerate(commands) if last(c)}


def test_run_report_counts_the_run(spark, tmp_path):
    path = str(tmp_path / "alerts")
    quiet = events(spark, [{"dst_port": 1, "event_id": 9}])
    assert detect_and_store(quiet, path).first()["alerts_generated"] == 0
    hit = events(spark, [{"dst_port": 23, "event_id": 1}])
    assert detect_and_store(hit, path).first()["alerts_generated"] == 1
    again = events(spark, [{"dst_port": 23, "event_id": 2}])
    assert detect_and_store(again, path).first()["alerts_generated"] == 1
    assert detect_and_store(quiet, path).first()["alerts_generated"] == 0
    assert spark.read.parquet(path).count() == 2


def test_pattern_and_ioc_rules_share_a_scan(spark):
    df = events(spark, [{"dst_port": 23, "src_ip": "9.9.9.9"}])
    ioc = Rule("i", "", "ioc", "", "high", ioc_values=("9.9.9.9",), signature_id=50)
    assert rows(stateless_matches(df, [*DEFAULT_RULES, ioc]).select("signature_id"), "signature_id") == [(7,), (50,)]


def test_details_keep_declared_order():
    rule = pattern(Condition("b", "regex", pattern="x"), Condition("a", "in", values=("u", 1)))
    assert details_json(rule) == '{"b":"matches pattern x","a":"in [\'u\', 1]"}'


def test_signature_alert_without_matches(spark):
    df = events(spark, [{"dst_port": 1}])
    assert signature_alerts(pattern_matches(df, DEFAULT_RULES), DEFAULT_RULES, now()).count() == 0


def test_rule_written_as_mapping(spark):
    rule = rule_from_dict({
        "name": "w", "rule_type": "pattern", "rule_content": "x", "severity": "low", "signature_id": 3,
        "conditions": {"dst_port": 22, "src_ip": {"type": "regex", "pattern": "^10"}, "bytes_sent": {"type": "range", "max": 5}},
    })
    df = events(spark, [{"dst_port": 22, "src_ip": "10.1.1.1", "bytes_sent": 5}, {"dst_port": 22, "src_ip": "10.1.1.1", "bytes_sent": 6}])
    assert hit_ids(df, rule) == [0]
    count = rule_from_dict({
        "name": "c", "rule_type": "threshold", "rule_content": "x", "severity": "low",
        "conditions": {"threshold": 2, "time_window_seconds": 9, "grouping_key": "username", "dst_port": 1},
    })
    assert (count.threshold, count.time_window_seconds, count.grouping_key, len(count.conditions)) == (2, 9, "username", 1)
    assert (count.confidence, count.enabled, count.description) == (1.0, True, "")
    with pytest.raises(ValueError, match="severity"):
        rule_from_dict({"name": "w", "rule_type": "pattern", "rule_content": "x"})


def test_indicators_as_a_table_find_the_same(spark):
    import random

    from palisade.rules.indicators import indicator_matches

    draw = random.Random(9)
    words = ["http://a.b/c", "http://a.b/d", "http", "su", "x", "sudo", "10.0.0.1", "10.0.0.2", "ncat", "é🙂é", "no such"]
    data = [{"event_id": i, "src_ip": draw.choice(["10.0.0.1", "10.0.0.3", None]), "dst_ip": draw.choice(["10.0.0.2", "x9", None])} for i in range(40)]
    hosts = [{"event_id": 100 + i, "process_name": draw.choice(["ncat", "nc", "", None]), "src_ip": "10.0.0.1",
              "command_line": draw.choice([None, "", "".join(draw.choice(words + [" ", "y"]) for _ in range(4))])} for i in range(150)]
    table = events(spark, data).unionByName(events(spark, hosts, "host"))
    rules = [Rule("a", "", "ioc", "", "low", None, ioc_values=tuple(words), confidence=0.3, signature_id=1),
             Rule("b", "", "ioc", "", "low", "host", ioc_values=tuple(reversed(words)), signature_id=2),
             Rule("c", "", "ioc", "", "low", "network", ioc_values=("10.0.0.2", "sudo"), signature_id=3),
             Rule("d", "", "ioc", "", "low", "network", ioc_values=("10.0.0.1",), enabled=False, signature_id=4),
             Rule("e", "", "ioc", "", "low", None, signature_id=5)]
    names = ["event_id", "signature_id", "confidence", "details"]
    got = rows(indicator_matches(table, rules).select(*names), "event_id", "signature_id")
    assert got == rows(ioc_rule_matches(table, rules).select(*names), "event_id", "signature_id") and len(got) > 150
    assert indicator_matches(table.limit(0), rules).count() == 0 and indicator_matches(table, rules[4:]).count() == 0


def test_command_lines_are_not_broadcast(spark):
    """Taken apart they are many times their size; only the list may be sent to every task, if it is short."""
    from palisade.rules.indicators import indicator_matches
    from tests.plans import broadcast_rows

    line = F.concat(F.lit("wget http://a.b/"), F.col("id").cast("string"))
    hosts = events(spark, [{}], "host").drop("event_id", "command_line")
    hosts = hosts.crossJoin(spark.range(300).select(F.col("id").alias("event_id"), line.alias("command_line")))
    listed = spark.range(20_000).select(
        F.lit(1).cast("long").alias("signature_id"), F.col("id").alias("position"), F.concat(F.lit("http://a.b/"), F.col("id").cast("string")).alias("value")
    )
    rule = Rule("a", "", "ioc", "", "low", "host", signature_id=1)
    joins.BROADCAST_ROWS, before = 1000, joins.BROADCAST_ROWS
    try:
        got = indicator_matches(hosts, [rule], listed)
        assert got.count() == 300
        # 300 lines, 20 runs each.
        assert broadcast_rows(got) <= 1000
    finally:
        joins.BROADCAST_ROWS = before


def test_no_method_is_too_long_to_be_compiled(spark):
    """The code of all rules in one pass is longer than what the JVM compiles, so it is not run as one method."""
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
