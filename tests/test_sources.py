"""Parsers, readers and sinks, with malformed input."""

import io
import struct
from datetime import datetime

import pandas as pd
import pytest
from helpers import events, lines, rows
from pyspark.sql import functions as F

from palisade.functions.indicators import indicator_type, url_host
from palisade.functions.timestamps import parse_timestamp, squeeze
from palisade.operators.alerts import to_alert_schema
from palisade.operators.reports import retained
from palisade.plans.detect import detect, detect_and_store
from palisade.plans.ingest import ingest, read_sources
from palisade.rules.catalog import DEFAULT_RULES
from palisade.session import drop_written, written
from palisade.sources import capture_chain, captures, datasets, feeds, logs, sinks
from palisade.sources.captures import decode_packets, read_captures
from palisade.sources.flows import flow_events


def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


NOW_TEXT = "2024-02-01 00:00:00"


def text(spark, *texts):
    return logs.parse_text_lines(lines(spark, texts), F.lit(2023), now())


def test_syslog(spark):
    got = text(
        spark, "<34>Jan  5 10:00:01 h1 sshd[42]: Failed login: bob", "<13>Dec 15 23:59:59 h2 cron: x",
        "<34>oops", "<34>Jan 5 10:00:01 h1 sshd[42]:", "  # comment", "", "   ",
    ).select(
        "event_id", F.col("timestamp").cast("string").alias("t"), "hostname", "process_name", "process_id",
        F.get_json_object("raw_data", "$.priority").alias("p"), F.get_json_object("raw_data", "$.message").alias("m"),
        "source", "event_type", "parse_error",
    )
    assert rows(got, "event_id") == [
        (0, "2023-01-05 10:00:01", "h1", "sshd", 42, "34", "Failed login: bob", "f.log", "host", False),
        (1, "2023-12-15 23:59:59", "h2", "cron", None, "13", "x", "f.log", "host", False),
    ]


def test_audit(spark):
    got = text(
        spark,
        'type=SYSCALL msg=audit(1364481363.243:24287): pid=3538 uid=0 comm="cat" a0=ff success=yes exit=3',
        'type=EXECVE msg=nothing pid=abc uid=5 uid=6 comm="two words" a0="" hostname=h',
        "type=SYSCALL nothing else",
    ).select(
        "event_id", F.col("timestamp").cast("string").alias("t"), "username", "process_name", "process_id",
        "command_line", "hostname", F.get_json_object("raw_data", "$.audit_type").alias("ty"),
        F.get_json_object("raw_data", "$.all_fields.exit").alias("ex"), "parse_error",
    )
    assert rows(got, "event_id") == [
        (0, "2013-03-28 14:36:03.243", "0", "cat", 3538, "ff", None, "SYSCALL", "3", False),
        (1, None, "6", "two words", None, "", "h", "EXECVE", None, True),
        (2, NOW_TEXT, None, None, None, None, None, "SYSCALL", None, False),
    ]


def test_generic_lines(spark):
    got = text(spark, "\t hello <34> world \t").select(
        F.col("timestamp").cast("string").alias("t"), F.get_json_object("raw_data", "$.message").alias("m"), "process_name"
    )
    assert rows(got) == [(NOW_TEXT, "hello <34> world", None)]


def test_json_lines(spark):
    got = logs.parse_json_lines(
        lines(spark, [
            '{"@timestamp":"2024-01-01T00:00:00Z","host":"h1","user":"bob","process":"bash","pid":7,"command":"ls | wc","message":"login ok"}',
            '{"timestamp":"","time":1704067200.5,"hostname":"","computer":"c","username":"u","ProcessName":"p","ProcessId":"0x1f4","CommandLine":"x"}',
            '{"broken": ', "", "  ", "[1, 2]", "5", '{"timestamp": "junk"}', "{}",
        ]),
        F.lit(2024), now(),
    ).select(
        "event_id", F.col("timestamp").cast("string").alias("t"), "hostname", "username", "process_name",
        "process_id", "command_line", "parse_error",
    )
    assert rows(got, "event_id") == [
        (0, "2024-01-01 00:00:00", "h1", "bob", "bash", 7, "ls | wc", False),
        (1, "2024-01-01 00:00:00.5", "c", "u", "p", 500, "x", False),
        (7, None, None, None, None, None, None, True),
        (8, NOW_TEXT, None, None, None, None, None, False),
    ]


def test_timestamps(spark):
    cases = {
        "2024-01-02T03:04:05.123456Z": "2024-01-02 03:04:05.123456",
        "2024-01-02T03:04:05.1234567Z": "2024-01-02 03:04:05.123456",
        "2024-01-02T03:04:05Z": "2024-01-02 03:04:05",
        "2024-01-02T03:04:05+02:00": "2024-01-02 01:04:05",
        "2024-01-02 03:04:05": "2024-01-02 03:04:05",
        "2024-01-02 03:04:05.5": "2024-01-02 03:04:05.5",
        "Feb 29 03:04:05": "2024-02-29 03:04:05",
        "Jan  2 03:04:05": "2024-01-02 03:04:05",
        "1704164645": "2024-01-02 03:04:05",
        "1704164645.250000": "2024-01-02 03:04:05.25",
        "Feb 31 03:04:05": None, "tomorrow": None, "2024-13-01": None, "": None, "12:30": None,
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    got = df.withColumn("t", squeeze(F.col("t"))).withColumn(
        "got", parse_timestamp(F.col("t"), F.lit(2024)).cast("string")
    )
    assert got.where(~F.col("got").eqNullSafe(F.col("want"))).collect() == []


XML = """<?xml version="1.0"?><Events>
<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><EventID>4688</EventID>
<TimeCreated SystemTime="2024-01-02T03:04:05.1234567Z"/><Computer>pc1</Computer></System>
<EventData><Data Name="TargetUserName">bob</Data><Data Name="ProcessName">cmd.exe</Data>
<Data Name="ProcessId">0x1f4</Data><Data Name="CommandLine">a &lt; b &amp;&amp; c</Data><Data>unnamed</Data></EventData></Event>
<Event><System><EventID Qualifiers="0">1</EventID><Computer>pc2</Computer></System></Event>
<Event><EventData><Data Name="x">y</Data></EventData></Event>
</Events>"""


def test_xml_and_folder(spark, tmp_path):
    (tmp_path / "w.xml").write_text(XML)
    (tmp_path / "a.log").write_text("<34>Jan  5 10:00:01 h1 sshd[42]: hi\n# c\n\nplain\n")
    (tmp_path / "b.json").write_text('{"host":"h9","time":"2024-01-01 00:00:00"}\nnot json\n')
    (tmp_path / "c.txt").write_text("ignored\n")
    xml = logs.read_xml_events(spark, str(tmp_path), F.lit(2024), now(), "*.xml").select(
        F.get_json_object("raw_data", "$.event_id").alias("n"), F.col("timestamp").cast("string").alias("t"),
        "hostname", "username", "process_name", "process_id", "command_line", "source",
    )
    assert rows(xml, "n") == [
        ("1", NOW_TEXT, "pc2", None, None, None, None, "w.xml"),
        ("4688", "2024-01-02 03:04:05.123456", "pc1", "bob", "cmd.exe", 500, "a < b && c", "w.xml"),
    ]
    every = logs.read_log_directory(spark, str(tmp_path), F.lit(2024), now())
    assert rows(every.groupBy("source").count(), "source") == [("a.log", 2), ("b.json", 1), ("w.xml", 2)]
    ids = [r[0] for r in every.select("event_id").collect()]
    assert len(set(ids)) == 5 and ids == [r[0] for r in every.select("event_id").collect()]


def frame(proto, src, dst, body, v6=False, vlan=False):
    import ipaddress

    mac = b"\1" * 12 + (b"\x81\0\0\5" if vlan else b"")
    a, b = ipaddress.ip_address(src).packed, ipaddress.ip_address(dst).packed
    if v6:
        return mac + b"\x86\xdd" + struct.pack(">IHBB", 6 << 28, len(body), proto, 9) + a + b + body
    return mac + b"\x08\0" + struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 1, 0, 7, proto, 0) + a + b + body


TCP = struct.pack(">HHIIBBHHH", 1234, 80, 7, 8, 0x50, 0x12, 99, 0, 0)
UDP = struct.pack(">HHHH", 53, 5353, 8, 0)
FRAMES = [
    frame(6, "10.0.0.1", "8.8.8.8", TCP), frame(17, "10.0.0.0", "8.8.0.0", UDP, vlan=True),
    frame(1, "10.0.0.1", "8.8.8.8", b"\x08\x01\0\0"), frame(47, "1.1.1.1", "2.2.2.2", b"abcd"),
    b"\1" * 12 + b"\x08\x06" + b"\0" * 28, frame(6, "fe80::1", "fe80::2", TCP, v6=True),
    frame(0, "fe80::1", "fe80::2", struct.pack(">BB6x", 17, 0) + UDP, v6=True),
    frame(6, "10.0.0.1", "8.8.8.8", TCP[:8]),
]


def capture(order="<", nano=False):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate(FRAMES):
        out += struct.pack(order + "IIII", 1704067200 + i, 500_000_000 if nano else 500_000, len(f), len(f)) + f
    return out


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("nano", [False, True])
def test_capture_decoding(order, nano):
    (got,) = decode_packets("x", capture(order, nano))
    assert list(got["packet_no"]) == [0, 1, 2, 3, 5, 6, 7]
    assert list(got["transport"]) == ["TCP", "UDP", "ICMP", "", "TCP", "UDP", ""]
    assert got["src_ip"].tolist() == ["10.0.0.1", "10.0.0.0", "10.0.0.1", "1.1.1.1", "fe80::1", "fe80::1", "10.0.0.1"]
    assert got["dst_ip"].tolist()[1] == "8.8.0.0"
    assert got["src_port"].tolist()[0] == 1234 and got["dst_port"].tolist()[1] == 5353
    assert got["ts_us"].tolist()[0] == 1704067200_500_000
    assert got["icmp_code"].tolist()[2] == 1 and got["ttl"].tolist()[:2] == [7, 7]


def test_cut_off_capture_keeps_whole_packets():
    (got,) = decode_packets("x", capture()[:-5])
    assert len(got) == 6


def test_capture_folder(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(capture())
    (tmp_path / "b.pcap").write_bytes(capture(">", True))
    (tmp_path / "c.bin").write_bytes(b"no capture")
    got = read_captures(spark, str(tmp_path))
    assert got.count() == 14 and got.select("event_id").distinct().count() == 14
    first = got.where("protocol = 'TCP' and src_ip = '10.0.0.1' and dst_port = 80").first()
    assert first["bytes_sent"] == len(FRAMES[0]) and first["packets_sent"] == 1
    assert first["timestamp"] == datetime(2024, 1, 1, 0, 0, 0, 500000)
    flags = got.select(F.get_json_object("raw_data", "$.tcp_flags").alias("f")).distinct()
    assert sorted(r[0] or "" for r in flags.collect()) == ["", "SA"]
    assert {r[0] for r in got.select("protocol").distinct().collect()} == {"TCP", "UDP", "ICMP", "GRE", "IPv6"} - {"IPv6"}


def ip(proto=17, body=UDP, v6=False):
    return frame(proto, *(("fe80::1", "fe80::2") if v6 else ("10.0.0.1", "8.8.8.8")), body, v6=v6)[14:]


LINKED = [
    (0, b"\2\0\0\0" + ip()), (0, b"\x1e\0\0\0" + ip(v6=True)), (12, ip()), (14, ip()), (101, ip(v6=True)), (108, b"\0\0\0\2" + ip()),
    (113, b"\0" * 14 + b"\x08\0" + ip()), (113, b"\0" * 14 + b"\x81\0\0\7\x86\xdd" + ip(v6=True)),
    (228, ip()), (229, ip(v6=True)), (276, b"\x08\0" + b"\0" * 18 + ip()), (276, b"\x86\xdd" + b"\0" * 18 + ip(v6=True)),
    (1, b"\1" * 12 + b"\x88\xa8\0\1\x81\0\0\2\x81\0\0\3\x08\0" + ip()),
    (1, b"\1" * 12 + struct.pack(">H", len(ip()) + 8) + b"\xaa\xaa\3\0\0\0\x08\0" + ip()),
    # No IP: another type, a length without one, an unknown link.
    (1, b"\1" * 12 + b"\x08\x06" + ip()), (1, b"\1" * 12 + b"\0\x40" + ip()), (147, ip()), (113, b"\0" * 14 + b"\0\1" + ip()), (101, b""),
]


@pytest.mark.parametrize("link, data", LINKED)
def test_every_link_type(link, data):
    out = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, link) + struct.pack("<IIII", 1, 2, len(data), len(data)) + data
    got = list(decode_packets("x", out))
    found = LINKED.index((link, data)) < 14
    assert sum(len(g) for g in got) == found
    if found:
        assert got[0]["src_port"].tolist() == [53] and got[0]["src_ip"][0] in ("10.0.0.1", "fe80::1")
        assert got[0]["length"].tolist() == [len(data)] and got[0]["ts_us"].tolist() == [1_000_002]


def section(order, *blocks):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        size = struct.pack(order + "I", len(body) + 12)
        return struct.pack(order + "I", kind) + size + body + size

    head = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))
    return head + b"".join(block(*b) for b in blocks)


def blocks_of(order):
    """Two interfaces, one with a clock of 2^-20 s that is 5 s behind, and packets of all kinds."""
    p = order + "IIIII"
    slow = struct.pack(order + "HHI", 101, 0, 40) + struct.pack(order + "HHB3xHHq", 9, 1, 0x80 | 20, 14, 8, 5)
    data = ip()
    return section(
        order, (1, struct.pack(order + "HHI", 101, 0, 40)), (1, slow), (4, b"names"),
        (3, struct.pack(order + "I", len(data)) + data),
        (6, struct.pack(p, 1, 0, 3 << 20, len(data), len(data)) + data),
        (2, struct.pack(order + "HHIIII", 0, 9, 0, 7_000_000, len(data), len(data)) + data),
        (3, struct.pack(order + "I", 900) + data + data),
    )


def test_blocks_of_all_kinds_and_both_orders():
    data = blocks_of("<") + blocks_of(">")
    (got,) = decode_packets("x", data)
    assert got["ts_us"].tolist() == [0, 8_000_000, 7_000_000, 7_000_000] + [7_000_000, 8_000_000, 7_000_000, 7_000_000]
    # The last of each section is kept in part, as long as its interface says.
    assert got["length"].tolist() == [28, 28, 28, 40] * 2 and got["packet_no"].tolist() == list(range(8))


CAPTURES = {
    "classic": capture() * 1 + capture()[24:] * 6, "swapped": capture(">", True), "blocks": (blocks_of("<") + blocks_of(">")) * 4,
    "only a header": capture()[:24],
}


@pytest.mark.parametrize("name", list(CAPTURES))
@pytest.mark.parametrize("every", [1, 90, 250, 10**6])
def test_ranges_hold_the_same_packets(name, every, monkeypatch):
    monkeypatch.setattr(capture_chain, "BUFFER", 64)
    data = CAPTURES[name]
    peek = capture_chain.Buffered(io.BytesIO(data), len(data))
    found = list(capture_chain.entries(peek, len(data), every))
    assert all(error is None for *_, error in found)
    bounds = [(s.at, end) for s, end, _ in found]
    assert all(b == c for (_, b), (c, _) in zip(bounds, bounds[1:])) and (not bounds or bounds[-1][1] == len(data))
    parts = [f for s, end, _ in found for f in captures._packets("x", s, data[s.at : end], s.at)]
    whole = list(decode_packets("x", data))
    assert len(found) <= 1 + len(data) // every and (every > 1 or len(found) > 3 or name == "only a header")
    if whole:
        pd.testing.assert_frame_equal(pd.concat(parts, ignore_index=True), whole[0])


@pytest.mark.parametrize("data, packets, at, reason", [
    (b"", 0, 0, "empty file"), (b"no capture", 0, 0, "not a capture"), (capture()[:20], 0, 0, "cut off in the file header"),
    (capture() + b"\0" * 9, 7, len(capture()), "cut off in a record header"),
    (capture()[:-1], 6, len(capture()) - 16 - len(FRAMES[-1]), "cut off in a record"),
    (capture() + b"\xff" * 40, 7, len(capture()), "a record of 4294967295 bytes"),
    (blocks_of("<")[:-3], 3, len(blocks_of("<")) - 72, "cut off in a record"),
    (blocks_of(">") + struct.pack(">II", 6, 2) * 9, 4, len(blocks_of(">")), "a block of 2 bytes"),
    (section("<", (6, struct.pack("<IIIII", 0, 0, 0, 4, 4) + b"data")), 0, 28, "a packet of an unknown interface"),
    (section("<", (1, struct.pack("<HHI", 1, 0, 0)), (6, struct.pack("<IIIII", 0, 0, 0, 99, 99))), 0, 48, "a packet of 99 bytes in a block of 32"),
    (section("<", (1, b"")), 0, 28, "an interface block of 12 bytes"),
])
def test_broken_chains(data, packets, at, reason):
    found = list(capture_chain.entries(lambda a, n: data[a : a + n], len(data), 100))
    assert (found[-1][0].at, found[-1][2]) == (at, reason) and all(e is None for *_, e in found[:-1])
    assert sum(len(f) for f in decode_packets("x", data)) == packets
    assert sum(len(f) for s, end, e in found[:-1] for f in captures._packets("x", s, data[s.at : end], s.at)) == packets


def test_bad_files_stop_nothing(spark, tmp_path):
    (tmp_path / "a b%20é.pcap").write_bytes(capture())
    (tmp_path / "none.pcap").write_bytes(b"")
    (tmp_path / "empty é.pcap").write_bytes(b"")
    (tmp_path / "foreign.pcapng").write_bytes(b"PK" * 50)
    (tmp_path / "cut.pcap").write_bytes(capture()[:-1])
    (tmp_path / "deep").mkdir()
    found, errors = captures.read_packets(spark, str(tmp_path), every=200)
    assert found.count() == 13 and read_captures(spark, f"file://{tmp_path}").count() == 13
    want = {("none.pcap", "empty file"), ("empty é.pcap", "empty file"), ("foreign.pcapng", "not a capture"), ("cut.pcap", "cut off in a record")}
    assert {(r["path"].rsplit("/", 1)[1], r["error"]) for r in errors.collect()} == want
    again = captures.capture_index(captures._files(spark, str(tmp_path)))
    for f in tmp_path.glob("a*"):
        f.unlink()
    assert captures.capture_errors(again).count() == 2
    assert captures.capture_index(spark.createDataFrame([("file:/nowhere/x.pcap", 5)], "path string, length long")).first()["error"].startswith("not readable")


def test_flow_records(spark):
    df = spark.createDataFrame(
        [(1, 1704067200.25, "a", "b", 1, 2, 6, None, None), (2, None, "a", "b", None, None, 250, 7, 8)],
        "event_id long, timestamp double, srcaddr string, dstaddr string, srcport int, dstport int, protocol int, bytes long, packets long",
    )
    got = flow_events(df, now()).select(
        "event_id", F.col("timestamp").cast("string").alias("t"), "src_ip", "dst_port", "protocol",
        "bytes_sent", "packets_sent", "bytes_received", "source",
    )
    assert rows(got, "event_id") == [
        (1, "2024-01-01 00:00:00.25", "a", 2, "TCP", 0, 0, None, "netflow"),
        (2, NOW_TEXT, "a", None, "250", 7, 8, None, "netflow"),
    ]


def test_indicator_types(spark):
    cases = [
        ("1.2.3.4", "ip", "ip"), ("999.1.1.1", "ip", "ip"), ("a.example.com", "domain", "domain"),
        ("word", "domain", "domain"), ("a" * 32, "domain", "hash"), ("0" * 40, "domain", "hash"),
        ("f" * 64, "hash", "hash"), ("http://x/y", "url", "url"), ("https://x", "url", "url"),
        ("ftp://x", None, None), ("-a.com", None, None), ("a b", None, None),
    ]
    df = spark.createDataFrame(cases, "v string, a string, b string")
    bad = df.where(
        ~indicator_type(F.col("v")).eqNullSafe(F.col("a")) | ~indicator_type(F.col("v"), True).eqNullSafe(F.col("b"))
    )
    assert bad.collect() == []
    assert spark.sql("select 'https://A.Example:8/x' u").select(url_host(F.col("u"))).first()[0] == "a.example"


def test_feeds(spark, tmp_path):
    (tmp_path / "black").write_text("# c\n2024-01-01 00:00:00, 203.0.113.5 ,443\nnocomma\n\n")
    (tmp_path / "t.csv").write_text("IP,severity\n1.1.1.1,high\n,low\n2.2.2.2,\n")
    (tmp_path / "plain").write_text("evil.example\n# no\n http://x/y \n!!\n")
    got = feeds.read_feeds(spark, [
        feeds.Feed("Abuse_CH ssl", "http://u", str(tmp_path / "black")),
        feeds.Feed("table", "http://u/list.CSV", str(tmp_path / "t.csv")),
        feeds.Feed("plain", "http://u", str(tmp_path / "plain")),
        feeds.Feed("off", "http://u", str(tmp_path / "missing"), enabled=False),
    ])
    assert rows(got.select("source", "ioc_type", "value", "confidence", "severity", "threat_type"), "source", "value") == [
        ("abuse_ch", "ip", "203.0.113.5", 0.8, "high", "c2"),
        ("plain", "domain", "evil.example", 0.6, "medium", None),
        ("plain", "url", "http://x/y", 0.6, "medium", None),
        ("table", "ip", "1.1.1.1", 0.7, "high", "unknown"),
        ("table", "ip", "2.2.2.2", 0.7, None, "unknown"),
    ]


def test_datasets(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" Flow Duration, Label\n1,BENIGN\nInfinity,DoS\nx,DoS\n")
    (tmp_path / "b.csv").write_text("Other,Label\n5,BENIGN\n")
    got = datasets.flow_csv_set(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert set(got.columns) == {"row_id", "Flow Duration", "Other", "label"}
    cells = rows(got.select("`Flow Duration`", "Other", "label"))
    assert sorted(map(str, cells)) == sorted(map(str, [
        (1.0, None, "BENIGN"), (float("inf"), None, "DoS"), (None, None, "DoS"), (None, 5.0, "BENIGN"),
    ]))
    assert datasets.flow_csv_set(spark, [str(tmp_path / "a.csv")], sample_size=2).count() == 2
    (tmp_path / "c.csv").write_text("x\n1\n")
    assert [r["label"] for r in datasets.flow_csv_set(spark, [str(tmp_path / "c.csv")]).collect()] == ["BENIGN"]
    (tmp_path / "kdd").write_text(",".join(["0", "tcp", "http", "SF"] + ["1"] * 37 + ["normal", "20"]) + "\n")
    kdd = datasets.kdd_set(spark, str(tmp_path / "kdd"))
    assert len(kdd.columns) == 43 and kdd.first()["label"] == "normal" and "difficulty" not in kdd.columns
    with pytest.raises(ValueError, match="label"):
        datasets.labelled_csv_set(spark, str(tmp_path / "c.csv"))


def test_many_files_with_few_headers_are_one_read(spark, tmp_path):
    headers = ["a, b,Label", "Label,c.x,a", "b,b,\"x, y\"", "only"]
    for i in range(60):
        (tmp_path / f"f{i}.csv").write_text(f"{headers[i % 4]}\n" + "".join(f"{k},{10 * k},X\n" for k in range(i % 3)), encoding="latin-1")
    (tmp_path / "empty.csv").write_text("")
    got = datasets.flow_csv_set(spark, [str(tmp_path)])
    assert got.columns == ["row_id", "a", "b", "b_1", "x, y", "c_x", "only", "label"] or set(got.columns) == {
        "row_id", "a", "b", "b_1", "x, y", "c_x", "only", "label"}
    assert got.count() == sum(i % 3 for i in range(60)) and got.select("row_id").distinct().count() == got.count()
    by = lambda k: [i for i in range(60) if i % 4 == k]
    assert got.where("label = 'X'").count() == sum(i % 3 for i in by(0))
    assert got.agg(F.sum("c_x")).first()[0] == sum(10 * k for i in by(1) for k in range(i % 3))
    assert got.agg(F.sum("b_1")).first()[0] == sum(10 * k for i in by(2) for k in range(i % 3))
    few = datasets.flow_csv_set(spark, [str(tmp_path / f"f{i}.csv") for i in range(8)])
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString().split("\n"))
    assert size(few) == size(got)


def test_ingest_detect_store(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "caps").mkdir()
    (tmp_path / "logs" / "a.log").write_text("<34>Jan  5 10:00:01 h1 ncat[42]: hi\nplain\n")
    (tmp_path / "logs" / "b.json").write_text("")
    (tmp_path / "logs" / "c.xml").write_text(XML)
    (tmp_path / "caps" / "a.pcap").write_bytes(capture())
    table = str(tmp_path / "events")
    got = ingest(spark, table, str(tmp_path / "caps"), str(tmp_path / "logs"))
    assert got == {"network": 7, "host": 4, "total": 11}
    assert ingest(spark, table, captures=str(tmp_path / "nowhere")) == {"network": 0, "total": 0}
    stored = sinks.read_events(spark, table)
    assert stored.select("event_id").distinct().count() == 11
    assert stored.count() == 11 and {"event_date", "event_type"} <= set(stored.columns)
    assert ingest(spark, str(tmp_path / "twice"), logs=str(tmp_path / "logs"))["total"] == 4
    assert ingest(spark, str(tmp_path / "twice"), logs=str(tmp_path / "logs"))["total"] == 4
    twice = spark.read.parquet(str(tmp_path / "twice"))
    assert twice.select("event_id").distinct().count() == 8
    alerts = str(tmp_path / "alerts")
    first = detect_and_store(stored, alerts).first()
    assert (first["events_processed"], first["alerts_generated"], first["critical"]) == (11, 1, 1)
    assert detect_and_store(stored, alerts).first()["alerts_generated"] == 1
    with pytest.raises(ValueError, match="no source"):
        read_sources(spark)


def test_event_span_reads_only_its_days(spark, tmp_path):
    table = str(tmp_path / "t")
    sinks.write_events(events(spark, [{"t": 86_400.0 * d, "event_id": d} for d in range(6)]), table)
    day = "2024-01-0{}".format
    span = sinks.read_events(
        spark, table, F.lit(day(2)).cast("timestamp"), F.lit(day(4)).cast("timestamp"), "network"
    )
    assert rows(span.select("event_id"), "event_id") == [(1,), (2,)]
    plan = span._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "event_date" in filters and "event_type" in filters
    now_day = F.lit("2024-01-06 12:00:00").cast("timestamp")
    young = retained(spark.read.parquet(table), "timestamp", now_day, 2, "event_date")
    assert rows(young.select("event_id"), "event_id") == [(4,), (5,)]


def test_written_tables_can_be_dropped(spark):
    drop_written(spark)
    table = written(spark.range(3), "x")
    assert table.count() == 3 and drop_written(spark) == 1 and drop_written(spark) == 0


def test_detect_one_type(spark):
    df = events(spark, [{"dst_port": 23}]).unionByName(events(spark, [{"process_name": "ncat"}], "host"))
    assert [r["title"] for r in detect(df, DEFAULT_RULES, now(), event_type="host").collect()] == ["Netcat Usage"]


def test_first_alerts_are_written_once(spark, tmp_path, monkeypatch):
    """Only a run that has to look up stored alerts keeps a copy of its own."""
    copies = []
    monkeypatch.setattr(sinks, "written", lambda df, name: copies.append(name) or written(df, name))
    one = spark.createDataFrame([("a", datetime(2024, 1, 1))], "alert_id string, created_at timestamp")
    alerts = to_alert_schema(one)
    for n, path in ((0, "x"), (1, "x")):
        sinks.write_alerts(alerts, str(tmp_path / path))
        assert len(copies) == n and spark.read.parquet(str(tmp_path / path)).count() == 1


def test_headers_are_found_without_putting_lines_in_order(spark, tmp_path, monkeypatch):
    plans = []

    def planned(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(datasets, "written", planned)
    for i, text in enumerate(["a,b,Label\n1,2,x\n", " Label,b\ny,4\n", "b, Label\n6,z\n0,z\n"]):
        (tmp_path / f"f{i}.csv").write_text(text)
    got = datasets.flow_csv_set(spark, [str(tmp_path)])
    assert rows(got.select("label", "a", "b"), "label", "b") == [("x", 1.0, 2.0), ("y", None, 4.0), ("z", None, 0.0), ("z", None, 6.0)]
    assert plans and not any("Sort" in p for p in plans)
