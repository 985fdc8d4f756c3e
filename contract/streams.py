"""Streaming queries: arrivals are processed one after the other and the stored
result is compared with the batch definition."""

from pyspark.sql import functions as F

from contract.adapters import (
    DAY,
    HOST_SQL,
    IOC_RULES,
    NET_SQL,
    TEST_RULES,
    all_events,
    created_at,
    host_events,
    net_events,
)
from contract.anomaly import FLOW_FEATURES
from contract.detection import IOC_SQL, PATTERN_SQL, THRESHOLD_SQL
from contract.features import FLOW_COLUMNS_SQL, FLOW_SQL, NET_DIGITS, _rounded
from contract.registry import ORACLES, query
from palisade.anomaly.forest import score_forest, train_forest
from palisade.operators.features import network_columns
from palisade.operators.profiles import host_profile
from palisade.schemas import EVENT_SCHEMA
from palisade.session import scratch_path
from palisade.streaming.state import Bounds
from palisade.streaming.detect_stream import (
    latest,
    read_event_files,
    start_trailing,
    windowed_counts,
)
from palisade.streaming.keyed import start_indicator_detection, start_keyed_detection, start_keyed_flows

# Arrivals of about ten days each; together they are the whole table.
CUTS = ["2024-01-11 00:00:00", "2024-01-21 00:00:00"]


def arrivals(events):
    """The events cut by time into consecutive arrivals."""
    cuts = [F.lit(c).cast("timestamp") for c in CUTS]
    time = F.col("timestamp")
    yield events.where(time < cuts[0])
    for low, high in zip(cuts, cuts[1:]):
        yield events.where((time >= low) & (time < high))
    yield events.where(time >= cuts[-1])


# Later than any row of the month can be.
ANY_ORDER = Bounds(late_seconds=40 * DAY)


def shuffled(events):
    """The events in arrivals that have nothing to do with time, and one of the far future
    among the first."""
    part = F.pmod(F.xxhash64("event_id"), F.lit(3))
    future = events.orderBy("event_id").limit(1).select(
        *[
            F.lit(-1).cast("long").alias(c) if c == "event_id"
            else F.lit("2099-01-01 00:00:00").cast("timestamp").alias(c) if c == "timestamp"
            else F.col(c)
            for c in events.columns
        ]
    )
    yield events.where(part == 0).unionByName(future)
    yield events.where(part == 1)
    yield events.where(part == 2)


def process(spark, events, start, arrivals=arrivals):
    """Land each arrival, then run the stream until it has caught up."""
    inbox = scratch_path(spark, "inbox")
    for arrival in arrivals(events):
        arrival.write.mode("append").parquet(inbox)
        stream = read_event_files(spark, inbox, EVENT_SCHEMA, files_per_batch=10_000)
        start(stream).awaitTermination()


@query(
    "stream_alerts",
    f"""WITH {NET_SQL}, {HOST_SQL}, {PATTERN_SQL}, {THRESHOLD_SQL}
    SELECT event_id, CAST(signature_id AS BIGINT) AS signature_id, round(confidence, 6) AS confidence FROM pat
    UNION ALL SELECT event_id, signature_id, round(confidence, 6) FROM thr""",
)
def stream_alerts(spark, sf):
    """All rules on a stream, thresholds counted across arrivals."""
    return _alerts_of(spark, all_events(spark, sf), "stream-alerts")


@query("stream_alerts_shuffled", ORACLES["stream_alerts"])
def stream_alerts_shuffled(spark, sf):
    """The same alerts from rows that arrive in any order, beside one dated 2099."""
    return _alerts_of(spark, all_events(spark, sf), "stream-shuffled", shuffled, ANY_ORDER)


def _alerts_of(spark, events, name, order=arrivals, bounds=Bounds(), rules=TEST_RULES):
    base = scratch_path(spark, name)
    process(
        spark,
        events,
        lambda stream: start_keyed_detection(
            stream, rules, f"{base}/alerts", f"{base}/checkpoint", created_at(), once=True, bounds=bounds
        ),
        order,
    )
    return latest(spark.read.parquet(f"{base}/alerts"), "alert_id", "version").select(
        "event_id", "signature_id", F.round("confidence_score", 6).alias("confidence")
    )


@query(
    "stream_indicator_alerts",
    f"WITH {NET_SQL}, {HOST_SQL}, {IOC_SQL} SELECT event_id, CAST(signature_id AS BIGINT) AS signature_id, round(confidence, 6) AS confidence FROM ioc",
)
def stream_indicator_alerts(spark, sf):
    """Indicator rules on a stream."""
    base = scratch_path(spark, "stream-indicators")
    process(
        spark,
        all_events(spark, sf),
        lambda stream: start_indicator_detection(
            stream, IOC_RULES, f"{base}/alerts", f"{base}/checkpoint", created_at=created_at(), once=True
        ),
    )
    return spark.read.parquet(f"{base}/alerts").select(
        "event_id", "signature_id", F.round("confidence_score", 6).alias("confidence")
    )


@query("stream_host_profile", ORACLES["host_profile"])
def stream_host_profile(spark, sf):
    """One-day host profiles on a stream, looking back across arrivals."""
    base = scratch_path(spark, "stream-hosts")
    process(
        spark,
        host_events(spark, sf),
        lambda stream: start_trailing(
            stream, lambda known: host_profile(known, DAY), DAY,
            f"{base}/out", f"{base}/state", f"{base}/checkpoint", once=True,
        ),
    )
    return spark.read.parquet(f"{base}/out").select(
        "event_id", "failed_login_count", "privilege_escalation_attempts",
        F.round("file_access_rate", 6).alias("file_access_rate"), "network_connection_count",
    )


@query(
    "stream_flow_stats",
    f"WITH {NET_SQL}, {FLOW_SQL} SELECT event_id, {FLOW_COLUMNS_SQL} FROM flow",
)
def stream_flow_stats(spark, sf):
    """Running flow statistics whose state outlives each arrival."""
    return _flows_of(spark, net_events(spark, sf), "stream-flows")


@query("stream_flow_stats_shuffled", ORACLES["stream_flow_stats"])
def stream_flow_stats_shuffled(spark, sf):
    """The same statistics from rows that arrive in any order, beside one dated 2099."""
    return _flows_of(spark, net_events(spark, sf), "stream-flows-shuffled", shuffled, ANY_ORDER)


def _flows_of(spark, events, name, order=arrivals, bounds=Bounds()):
    base = scratch_path(spark, name)
    process(
        spark,
        events,
        lambda stream: start_keyed_flows(
            stream, f"{base}/out", f"{base}/checkpoint", 40 * DAY, once=True, bounds=bounds
        ),
        order,
    )
    out = latest(spark.read.parquet(f"{base}/out"), "event_id", "version")
    return _rounded(
        out.select("event_id", "flow_duration", "packets_per_second", "bytes_per_second"), NET_DIGITS
    )


@query(
    "stream_window_counts",
    f"""WITH {NET_SQL}, w AS (SELECT src_ip, CAST(date_trunc('day', ts) AS TIMESTAMP) - INTERVAL 1 DAY * unnest([0, 1]) AS s FROM net)
    SELECT src_ip, epoch_us(s) AS start_us, count(*) AS n_events FROM w GROUP BY ALL""",
)
def stream_window_counts(spark, sf):
    """Sliding two-day counts per source; updates are stored, the largest is final."""
    base = scratch_path(spark, "stream-windows")

    def start(stream):
        counts = windowed_counts(stream, ["src_ip"], "2 days", "1 day", "3 days")

        def store(batch, number):
            batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

        return (
            counts.writeStream.outputMode("update")
            .foreachBatch(store)
            .option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )

    process(spark, net_events(spark, sf), start)
    out = spark.read.parquet(f"{base}/out")
    return out.groupBy("src_ip", F.unix_micros("start").alias("start_us")).agg(
        F.max("n_events").alias("n_events")
    )


PLAIN = [c for c in FLOW_FEATURES if not c.startswith(("flow_", "packets_per", "bytes_per"))]


@query("stream_anomaly_scores", "SELECT event_id, TRUE AS as_in_batch FROM events")
def stream_anomaly_scores(spark, sf):
    """A forest trained on stored events scores the stream of them as it does the batch."""
    base = scratch_path(spark, "stream-scores")

    def features(events):
        return events.select(
            "event_id",
            *[c.cast("double").alias(n) for n, c in network_columns().items() if n in PLAIN],
        )

    stored = features(net_events(spark, sf))
    forest = train_forest(stored, PLAIN, "event_id")

    def start(stream):
        return (
            score_forest(features(stream), forest)
            .select("event_id", "score", "is_anomaly")
            .writeStream.format("parquet")
            .option("path", f"{base}/out")
            .option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )

    process(spark, net_events(spark, sf), start)
    batch = score_forest(stored, forest).select("event_id", F.col("score").alias("want"))
    return (
        spark.read.parquet(f"{base}/out")
        .join(batch, "event_id")
        .select("event_id", (F.abs(F.col("score") - F.col("want")) < 1e-12).alias("as_in_batch"))
    )
