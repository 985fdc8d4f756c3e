"""Rules of several steps, many rules, and sessions against brute force."""

import json
import random

import pytest
from helpers import events, rows

from palisade.operators.sessions import sessions
from palisade.rules.correlation import correlation_matches
from palisade.rules.index import indexed_matches
from palisade.rules.matching import match_events, pattern_matches
from palisade.rules.model import Condition, Rule, rule_from_dict, rules_frame, rules_from_frame
from pyspark.sql import functions as F


def step(port):
    return (Condition("dst_port", "equals", value=port),)


def chain(*ports, window=90, reset=(), key="src_ip", **more):
    return Rule("chain", "", "correlation", "", "low", None, steps=tuple(step(p) for p in ports), reset=reset,
                time_window_seconds=window, grouping_key=key, signature_id=len(ports), **more)


RESET = (Condition("dst_port", "equals", value=9),)


def brute(data, rule, ports):
    """event -> latest beginning, by trying all chains."""
    out = {}
    data = sorted(data, key=lambda e: (e["t"], e["event_id"]))
    by_group = {}
    for e in data:
        if e["src_ip"]:
            by_group.setdefault(e["src_ip"], []).append(e)
    for group in by_group.values():
        # Chains that got k steps far, as beginnings.
        open_ = [[] for _ in ports]
        for e in group:
            if rule.reset and e["dst_port"] == 9:
                open_ = [[] for _ in ports]
            for k in reversed(range(len(ports))):
                if e["dst_port"] != ports[k]:
                    continue
                begins = [e["t"]] if k == 0 else list(open_[k - 1])
                open_[k] += begins
                if k == len(ports) - 1:
                    fits = [b for b in begins if e["t"] - b <= rule.time_window_seconds]
                    if fits:
                        out[e["event_id"]] = max(fits)
    return out


@pytest.mark.parametrize("ports, reset", [((1, 2), ()), ((1, 2, 3), RESET), ((1, 1, 2), ()), ((9, 1, 2, 1), RESET)])
def test_chains_like_brute_force(spark, way, ports, reset):
    draw = random.Random(len(ports))
    data = [{"event_id": i, "t": float(draw.randrange(300)), "src_ip": draw.choice(["a", "b", "", None]),
             "dst_port": draw.choice([1, 2, 3, 4, 9, None])} for i in range(250)]
    rule = chain(*ports, reset=reset)
    got = correlation_matches(events(spark, data).repartition(3), [rule, chain(7, 8), chain(1)])
    got = {r["event_id"]: json.loads(r["details"])["began_us"] / 1e6 - 1_704_067_200 for r in got.collect()}
    assert got == brute(data, rule, ports) and len(got) > 2


def test_chains_among_all_rules(spark):
    data = [{"event_id": i, "t": float(i), "src_ip": "a", "dst_port": p} for i, p in enumerate([1, 2, 3, 3])]
    table = events(spark, data)
    telnet = Rule("p", "", "pattern", "", "low", None, step(2), signature_id=50)
    found = match_events(table, [chain(1, 2, 3, confidence=0.5), telnet, Rule("old", "", "correlation", "", "low")])
    assert rows(found.select("event_id", "signature_id", "confidence"), "event_id") == [(1, 50, 1.0), (2, 3, 0.5), (3, 3, 0.5)]
    off = chain(1, 2, 3, enabled=False)
    assert correlation_matches(table, [off]).count() == 0 and correlation_matches(table.limit(0), [chain(1, 2)]).count() == 0


def test_steps_are_written_and_stored(spark):
    written = rule_from_dict({
        "name": "n", "rule_type": "correlation", "rule_content": "", "severity": "low",
        "conditions": {"steps": [{"dst_port": 22}, {"protocol": {"type": "in", "values": ["TCP"]}, "bytes_sent": {"type": "range", "min": 5}}],
                       "reset": {"raw_data.x": {"type": "contains", "value": "y"}}, "time_window_seconds": 9},
    })
    assert written.conditions == () and [len(s) for s in written.steps] == [1, 2] and written.reset[0].op == "contains"
    (back,) = rules_from_frame(rules_frame(spark, [written]))
    assert [[c.field for c in s] for s in back.steps] == [["dst_port"], ["protocol", "bytes_sent"]]
    table = events(spark, [{"t": 0.0, "src_ip": "a", "dst_port": 22}, {"t": 8.0, "src_ip": "a", "protocol": "TCP", "bytes_sent": 7}])
    assert correlation_matches(table, [back]).count() == correlation_matches(table, [written]).count() == 1


def many(draw):
    words = ["sudo", "wget", "nc", "cat /etc/passwd", "su", "ab~cd=ef"]
    out = []
    for i in range(150):
        tests = draw.sample([
            Condition("dst_port", "equals", value=draw.randrange(5)), Condition("dst_port", "in", values=(1, "2", True, None)),
            Condition("bytes_sent", "range", min=draw.randrange(40), max=60 if i % 2 else None),
            Condition("command_line", "contains", value=draw.choice(words)),
            Condition("command_line", "regex", pattern=draw.choice(["^SU", "passwd$", "c.t"])),
            Condition("process_name", "equals", value=draw.choice(["x", "=", "", "é"])),
            Condition("raw_data.n", "equals", value="5"), Condition("raw_data.n", "range", max=4),
            Condition("no_such", "equals", value="x"), Condition("protocol", "equals", value="TCP"),
            Condition("features.total_bytes", "equals", value=7.0), Condition("features.total_bytes", "equals", value=0.5),
        ], draw.randrange(4))
        kind = draw.choice(["network", "host", None])
        out.append(Rule(f"r{i}", "", "pattern", "", "low", kind, tuple(tests), enabled=i % 9 > 0, confidence=i / 200, signature_id=i + 1))
    return out


def test_index_finds_what_columns_find(spark):
    draw = random.Random(7)
    data = [{"event_id": i, "dst_port": draw.choice([None, 0, 1, 2, 3, 4]), "bytes_sent": draw.choice([None, 7, 50, 70]),
             "command_line": draw.choice([None, "", "su", "sudo su", "cat /etc/passwd", "Cat", "xab~cd=ef", "ab~c"]),
             "process_name": draw.choice([None, "x", "=", "", "é"]), "protocol": draw.choice(["TCP", None, "udp"]),
             "raw_data": draw.choice([None, '{"n": 5}', '{"n": "5"}', '{"n": 3.5}', "no json"])} for i in range(200)]
    table = events(spark, data).unionByName(events(spark, [{**d, "event_id": d["event_id"] + 1000} for d in data], "host"))
    total = F.when(F.col("event_id") % 3 > 0, F.col("bytes_sent").cast("double")).otherwise(F.lit(0.5))
    table = table.withColumn("features", F.struct(total.alias("total_bytes")))
    rules = many(draw)
    names = ["event_id", "signature_id", "confidence", "details"]
    got = rows(indexed_matches(table.repartition(3), rules).select(*names), "event_id", "signature_id")
    assert got == rows(pattern_matches(table, rules).select(*names), "event_id", "signature_id") and len(got) > 500
    assert indexed_matches(table.limit(0), rules).count() == 0 and indexed_matches(table, []).count() == 0
    ranges = [r for r in rules if all(c.op in ("range", "regex") for c in r.conditions)]
    assert indexed_matches(table, ranges).count() == pattern_matches(table, ranges).count() > 0


def test_rules_that_share_an_entry_fall_by_another(spark):
    """20 rules are filed under each port; the other port leaves one of them for each event."""
    from tests.plans import joined_rows

    table = events(spark, [{"event_id": i, "src_port": 1 + i % 20, "dst_port": 1 + i // 20} for i in range(400)])
    rules = [
        Rule("r", "", "pattern", "", "low", None, signature_id=i, conditions=(
            Condition("src_port", "equals", value=1 + i % 20), Condition("dst_port", "in", values=(1 + i // 20, 99))))
        for i in range(400)
    ]
    got = indexed_matches(table, rules)
    assert rows(got.select("event_id", "signature_id"), "event_id") == [(i, i) for i in range(400)]
    assert joined_rows(got) <= 1000


def test_plan_does_not_grow_with_rules(spark):
    table = events(spark, [{"dst_port": 1, "process_name": "x"}])
    def size(n):
        rules = [Rule("r", "", "pattern", "", "low", None, (Condition("process_name", "equals", value=f"v{i}"),), signature_id=i)
                 for i in range(n)]
        return len(indexed_matches(table, rules)._jdf.queryExecution().optimizedPlan().toString().split("\n"))
    assert size(5) == size(3000)


def test_unknown_condition(spark):
    with pytest.raises(ValueError):
        indexed_matches(events(spark, [{}]), [Rule("r", "", "pattern", "", "low", None, (Condition("dst_port", "like", value=1),))])


def test_sessions_like_windows(spark, way):
    draw = random.Random(3)
    data = [{"event_id": i, "t": float(draw.randrange(2000)), "src_ip": draw.choice(["a", "b", None]), "bytes_sent": i} for i in range(300)]
    table = events(spark, data)
    sums = {"n": F.count(F.lit(1)), "total": F.sum("bytes_sent")}
    got = rows(sessions(table.repartition(4), ["src_ip"], 5, sums), "src_ip", "start")
    window = F.session_window("timestamp", "5 seconds").alias("w")
    want = table.groupBy(window, "src_ip").agg(sums["n"].alias("n"), sums["total"].alias("total"))
    assert got == rows(want.select("src_ip", "w.start", "w.end", "n", "total"), "src_ip", "start") and len(got) > 100
    undated = table.withColumn("timestamp", F.lit(None).cast("timestamp"))
    assert sessions(undated, ["src_ip"], 5, sums).count() == 0
    assert sessions(table, [], 5, sums).agg(F.sum("n")).first()[0] == 300
