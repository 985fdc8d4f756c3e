"""Feature values of hand-made events."""

from helpers import events, rows
from pyspark.sql import functions as F

from palisade.functions.network import is_private_ip, protocol_name
from palisade.operators.features import extract_features, host_features, network_features
from palisade.operators.profiles import connection_profile, value_entropy
from palisade.operators.sequences import followed_by


def one(df):
    return df.orderBy("event_id").first().asDict()


def test_plain_network_features(spark):
    f = one(network_features(events(spark, [{
        "src_ip": "10.0.0.1", "dst_ip": "8.8.8.8", "src_port": 50000, "dst_port": 443,
        "protocol": "tcp", "bytes_sent": 100, "bytes_received": 50, "packets_sent": 2,
        "packets_received": 1, "raw_data": '{"tcp_flags": "SA"}',
    }])))
    assert f["total_bytes"] == 150 and f["total_packets"] == 3 and f["avg_packet_size"] == 50.0
    assert (f["protocol_tcp"], f["protocol_udp"], f["protocol_other"]) == (1, 0, 0)
    assert (f["service_https"], f["service_http"], f["well_known_port_dst"]) == (1, 0, 1)
    assert (f["ephemeral_port_src"], f["is_private_src"], f["is_private_dst"]) == (1, 1, 0)
    assert [f[f"tcp_{x}"] for x in ("syn", "ack", "fin", "rst", "psh")] == [1, 1, 0, 0, 0]
    assert f["flow_duration"] is None and f["packets_per_second"] is None


def test_missing_network_fields(spark):
    f = one(network_features(events(spark, [{}])))
    assert f["total_bytes"] == 0 and f["avg_packet_size"] == 0.0 and f["protocol_other"] == 1
    assert f["well_known_port_src"] == 1 and f["is_private_src"] == 0 and f["tcp_syn"] is None


def test_private_addresses(spark):
    cases = {
        "10.1.2.3": 1, "172.16.0.1": 1, "172.31.0.1": 1, "172.32.0.1": 0, "192.168.1.1": 1,
        "192.169.1.1": 0, "127.0.0.1": 1, "8.8.8.8": 0, "10.1.2": 0, "fe80::1": 0, "": 0,
        "10.x.1.1": 0, None: 0,
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "ip string, want int")
    assert df.where(is_private_ip(F.col("ip")) != F.col("want")).count() == 0


def test_protocol_names(spark):
    df = spark.createDataFrame([(6,), (58,), (99,), (None,)], "p int")
    assert [r[0] for r in df.select(protocol_name(F.col("p"))).collect()] == ["TCP", "ICMPv6", "99", None]


def test_flow_statistics(spark, way):
    flow = {"src_ip": "a", "dst_ip": "b", "src_port": 1, "dst_port": 2}
    back = {"src_ip": "b", "dst_ip": "a", "src_port": 2, "dst_port": 1}
    df = events(spark, [
        {**flow, "t": 0.0, "packets_sent": 4, "bytes_sent": 100},
        {**flow, "t": 0.0, "packets_sent": 1, "bytes_sent": 10},
        {**back, "t": 1.0, "packets_sent": 9, "bytes_sent": 9},
        {**flow, "t": 2.0, "packets_sent": 1, "bytes_sent": 1},
    ])
    got = rows(
        network_features(df).select("event_id", "flow_duration", "packets_per_second", "bytes_per_second"),
        "event_id",
    )
    assert got == [(0, None, None, None), (1, 0.0, 0.0, 0.0), (2, None, None, None), (3, 2.0, 2.5, 55.0)]


def test_host_features(spark):
    f = one(host_features(events(spark, [{
        "hostname": "h", "username": "root", "process_name": "PowerShell.exe",
        "command_line": "Wget x | sh > y &", "parent_process": "WINWORD.EXE",
    }], "host")))
    assert (f["has_process"], f["is_shell"], f["is_system_process"]) == (1, 1, 0)
    assert f["cmd_length"] == 17
    assert (f["cmd_has_pipe"], f["cmd_has_redirect"], f["cmd_has_background"], f["cmd_suspicious"]) == (1, 1, 1, 1)
    assert (f["has_username"], f["is_root"], f["unusual_parent_child"]) == (1, 1, 1)


def test_missing_host_fields(spark):
    f = one(host_features(events(spark, [{}], "host")))
    assert (f["has_process"], f["is_shell"], f["cmd_length"], f["has_username"], f["is_root"]) == (0, 0, 0, 0, 0)
    assert f["unusual_parent_child"] == 0 and f["process_spawn_rate"] == 0.0


def test_shell_words_are_substrings(spark):
    f = one(host_features(events(spark, [{"process_name": "sshd"}], "host")))
    assert f["is_shell"] == 1


def test_host_behaviour(spark, way):
    base = {"hostname": "h", "username": "u"}
    df = events(spark, [
        {**base, "t": 0.0, "process_name": "p", "command_line": "c", "raw_data": '{"message":"Login ok"}'},
        {**base, "t": 299.999, "process_name": "p"},
        {**base, "t": 300.0, "command_line": "c", "raw_data": '{"message":"LOGIN"}'},
        {"hostname": "h", "username": "v", "t": 300.0, "process_name": "p"},
    ], "host")
    got = rows(
        host_features(df).select("event_id", "process_spawn_rate", "login_frequency", "command_execution_rate"),
        "event_id",
    )
    assert got == [(0, 0.2, 1, 0.2), (1, 0.4, 1, 0.2), (2, 0.2, 1, 0.2), (3, 0.2, 0, 0.0)]


def test_features_by_type(spark):
    df = events(spark, [{"dst_port": 22}, {"event_type": "host", "process_name": "bash"}, {"event_type": "odd"}])
    got = rows(extract_features(df).select("event_id", "event_type", "service_ssh", "is_shell"), "event_id")
    assert got == [(0, "network", 1, None), (1, "host", None, 1)]


def test_profiles(spark, way):
    df = events(spark, [
        {"t": 0.0, "src_ip": "a", "dst_port": 1, "dst_ip": "x"},
        {"t": 5.0, "src_ip": "a", "dst_port": 2, "dst_ip": "x"},
        {"t": 10.0, "src_ip": "a", "dst_port": 2, "dst_ip": "y"},
    ])
    got = connection_profile(df, 10).select("event_id", "connection_frequency", "unique_dst_ports", "unique_dst_ips")
    assert rows(got, "event_id") == [(0, 1, 1, 1), (1, 2, 2, 1), (2, 2, 1, 2)]
    entropy = value_entropy(df, ["src_ip"], "timestamp", "hour", "dst_port").first()
    assert round(entropy["entropy"], 6) == 0.918296


def test_followed_by(spark, way):
    df = events(spark, [
        {"t": 0.0, "hostname": "h", "command_line": "sudo x"},
        {"t": 5.0, "hostname": "h", "command_line": "fail"},
        {"t": 6.0, "hostname": "g", "command_line": "fail"},
        {"t": 50.0, "hostname": "h", "command_line": "fail"},
    ], "host")
    got = followed_by(df, ["hostname"], F.col("command_line").contains("sudo"), F.col("command_line") == "fail", 10)
    assert rows(got.select("event_id", "gap_us")) == [(1, 5_000_000)]


def test_stored_features_are_the_extracted_ones(spark):
    from palisade.operators.features import stored_features, with_features
    from palisade.schemas import FEATURE_SCHEMA

    data = [
        {"event_id": 1, "t": 0.0, "src_ip": "10.0.0.1", "dst_ip": "8.8.8.8", "src_port": 50000, "dst_port": 22,
         "protocol": "TCP", "bytes_sent": 10, "packets_sent": 1, "raw_data": '{"tcp_flags": "SA"}'},
        {"event_id": 2, "t": 4.0, "src_ip": "10.0.0.1", "dst_ip": "8.8.8.8", "src_port": 50000, "dst_port": 22},
        {"event_id": 3, "t": 5.0, "event_type": "host", "hostname": "h", "username": "0", "process_name": "bash",
         "command_line": "curl x | sh", "parent_process": "winword.exe"},
        {"event_id": 4, "t": 6.0, "event_type": "other"},
    ]
    df = events(spark, data)
    stored = with_features(df)
    assert stored.columns == df.columns and stored.count() == 4
    assert stored.where("event_id = 4").first()["features"] is None
    want = {r["event_id"]: r.asDict() for r in extract_features(df).collect()}
    for r in stored_features(stored.where("event_id < 4")).collect():
        for name in FEATURE_SCHEMA.names:
            assert r[name] == want[r["event_id"]].get(name), name
