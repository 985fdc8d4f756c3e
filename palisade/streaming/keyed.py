"""Threshold rules and flow statistics as keyed state of a stream.

Spark keeps the state, its versions and its recovery; here is only what happens to one key. Rows
may come in any order within the stated lateness, which is the watermark's delay. A late row changes
the results of rows that came before it: those are given out again with a higher ``version``, and
:func:`palisade.streaming.detect_stream.latest` reads the newest.

- **Thresholds.** The key is (rule, group, slice): time is cut into slices of ``SLICE`` windows, and a row goes to
  the slice it lies in and to the next if that looks back on it. So a busy group is many keys, and
  what a key holds ends with its slice: a timer clears it once the watermark has passed.
- **Flows.** The key is one of a fixed number of buckets that flows are dealt to by their hash, as flows may be as many as rows;
  within it a flow is two hashes, 128 bits. Rows older than the watermark become totals (start, packets, bytes), so state is
  the rows of one lateness, and a timer forgets flows that were idle.

State values are arrays of numbers, one a batch, merged when there are many; counts are sorted
arrays and binary searches, no loops over rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from palisade.functions.timestamps import micros
from palisade.operators.alerts import signature_alerts
from palisade.operators.flow_state import KEYS, keyed
from palisade.rules.compile import field, rule_column
from palisade.rules.indicators import indicator_matches
from palisade.rules.matching import enabled_of, pattern_matches
from palisade.rules.model import Rule
from palisade.session import discard, written
from palisade.streaming.state import Bounds

US = 1_000_000
SLICE = 4
# Arrays of a key before they are merged into one.
PIECES = 32
# Keys that flows are dealt to: each costs calls between Spark and Python in every batch.
BUCKETS = 1024
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def in_time(events: DataFrame, bounds: Bounds = Bounds(), now: Column | None = None) -> DataFrame:
    """The rows of a stream that have a time no further ahead of the clock than allowed, with the
    lateness as their watermark. Spark drops and counts what is later."""
    clock = F.current_timestamp() if now is None else now
    ahead = F.expr(f"INTERVAL {bounds.skew_seconds} SECONDS")
    return events.where(F.col("timestamp") <= clock + ahead).withWatermark("timestamp", f"{bounds.late_seconds} seconds")


def out_of_time(events: DataFrame, bounds: Bounds = Bounds(), now: Column | None = None) -> DataFrame:
    """The rows that :func:`in_time` leaves out, with the ``reason``: ``undated`` or ``future``."""
    clock = F.current_timestamp() if now is None else now
    ahead = clock + F.expr(f"INTERVAL {bounds.skew_seconds} SECONDS")
    reason = F.when(F.col("timestamp").isNull(), "undated").when(F.col("timestamp") > ahead, "future")
    return events.withColumn("reason", reason).where("reason IS NOT NULL")


class _Rows:
    """Rows of whole numbers in a list state, in the order they came."""

    def __init__(self, handle: StatefulProcessorHandle, width: int):
        self.width = width
        self.state = handle.getListState("rows", T.StructType([T.StructField("piece", T.BinaryType())]))

    def pieces(self) -> list[np.ndarray]:
        return [np.frombuffer(p[0], np.int64).reshape(-1, self.width) for p in self.state.get()]

    def add(self, new: np.ndarray, old: list[np.ndarray]) -> None:
        if len(old) < PIECES:
            self.state.appendValue((new.tobytes(),))
        else:
            self.replace(np.concatenate([*old, new]))

    def replace(self, rows: np.ndarray) -> None:
        if rows.size:
            self.state.put([(rows.tobytes(),)])
        else:
            self.state.clear()


def _numbers(frames: Iterator[pd.DataFrame], names: list[str]) -> np.ndarray:
    return np.concatenate([f[names].to_numpy(np.int64) for f in frames])


def counts_of_rows(us: np.ndarray, width: int) -> np.ndarray:
    """For each row of a sorted array the number of rows up to it that are less than ``width`` older."""
    return np.arange(1, us.size + 1) - np.searchsorted(us, us - width, side="right")


def counts_of_values(us: np.ndarray, value: np.ndarray, width: int) -> np.ndarray:
    """For each row the number of different values, 0 aside, of rows less than ``width`` older or of the same time.

    A sighting of a value counts until its next one, or until it is too old.
    """
    seen = np.flatnonzero(value)
    order = seen[np.argsort(value[seen], kind="stable")]
    until = us[order] + width
    again = value[order[1:]] == value[order[:-1]] if order.size else np.zeros(0, bool)
    until[:-1] = np.where(again, np.minimum(until[:-1], us[order[1:]]), until[:-1])
    begun = np.searchsorted(us[seen], us, side="right")
    return begun - np.searchsorted(np.sort(until), us, side="right")


@dataclass(frozen=True)
class Counter:
    """What the state of a threshold rule needs to know, times in microseconds."""

    threshold: int
    width: int
    ports: bool

    @property
    def slice(self) -> int:
        return max(1, self.width) * SLICE


class ThresholdState(StatefulProcessor):
    """The exact trailing counts of one (rule, group, slice) that reach the threshold."""

    def __init__(self, counters: dict[int, Counter]):
        self.counters = counters

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = _Rows(handle, 3)
        self.version = handle.getValueState("version", T.StructType([T.StructField("n", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rule, group, piece = key
        counter = self.counters[int(rule)]
        new = _numbers(rows, ["us", "event_id", "port"])
        old = self.rows.pieces()
        version = self.version.get()[0] + 1 if self.version.exists() else 1
        known = np.concatenate([*old, new])
        known = known[np.lexsort((known[:, 1], known[:, 0]))]
        us = known[:, 0]
        n = counts_of_values(us, known[:, 2], counter.width) if counter.ports else counts_of_rows(us, counter.width)
        changed = (us >= max(int(piece) * counter.slice, int(new[:, 0].min()))) & (us < new[:, 0].max() + counter.width)
        fired = np.flatnonzero(changed & (n >= counter.threshold))
        self.rows.add(new, old)
        self.version.update((version,))
        if not old:
            self.handle.registerTimer((int(piece) + 1) * counter.slice // 1000 + 1)
        yield pd.DataFrame(
            {"signature_id": int(rule), "group": group, "event_id": known[fired, 1], "n": n[fired], "version": version}
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # No row that is still accepted lies in this slice.
        self.rows.state.clear()
        self.version.clear()
        yield pd.DataFrame(columns=["signature_id", "group", "event_id", "n", "version"])

    def close(self) -> None:
        pass


def threshold_rows(events: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(signature_id, group, slice, us, event_id, port, timestamp): a row for each rule that counts the event,
    and for each slice in which it counts."""
    found = []
    for r in rules:
        value, kind = field(events, r.grouping_key)
        given = value != 0 if isinstance(kind, T.NumericType) else value.cast("string") != ""
        width = Counter(r.threshold, r.time_window_seconds * US, r.counts_ports)
        found.append(
            F.when(
                rule_column(events, r) & given,
                F.struct(
                    F.lit(r.signature_id).cast("long").alias("signature_id"),
                    value.cast("string").alias("group"),
                    F.lit(width.slice).alias("length"),
                    F.lit(max(1, width.width)).alias("width"),
                ),
            )
        )
    some = F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("r")
    rows = events.select("event_id", "timestamp", micros(F.col("timestamp")).alias("us"), F.coalesce("dst_port", F.lit(0)).cast("long").alias("port"), some)
    slice_of = lambda us: F.floor(us / F.col("r.length")).cast("long")
    slices = F.sequence(slice_of(F.col("us")), slice_of(F.col("us") + F.col("r.width") - 1))
    return rows.select("r.signature_id", "r.group", F.explode(slices).alias("slice"), "us", "event_id", "port", "timestamp")


def keyed_threshold_matches(events: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(event_id, signature_id, confidence, details, version) of a stream with a watermark."""
    rules = [r for r in enabled_of(rules, "threshold") if r.threshold]
    counters = {r.signature_id: Counter(r.threshold, r.time_window_seconds * US, r.counts_ports) for r in rules}
    counted = (
        threshold_rows(events, rules)
        .groupBy("signature_id", "group", "slice")
        .transformWithStateInPandas(
            ThresholdState(counters),
            "signature_id long, group string, event_id long, n long, version long",
            "Append",
            "EventTime",
        )
    )

    def of(value) -> Column:
        """The value of each row's rule; rules are a few, and their values literals."""
        cases = [(F.col("signature_id") == r.signature_id, F.lit(value(r))) for r in rules]
        return reduce(lambda out, c: F.when(c[0], c[1]).otherwise(out), cases, F.lit(None))

    threshold = of(lambda r: r.threshold).cast("int")
    details = F.to_json(
        F.struct(
            F.col("n").alias("count"),
            threshold.alias("threshold"),
            of(lambda r: r.time_window_seconds).cast("int").alias("time_window"),
            F.concat(of(lambda r: r.grouping_key), F.lit("="), F.col("group")).alias("grouping"),
        )
    )
    confidence = of(lambda r: float(r.confidence)) * (F.col("n") / threshold.cast("double"))
    return counted.select(
        "event_id", "signature_id", F.least(F.lit(1.0), confidence).alias("confidence"), details.alias("details"), "version"
    )


def _running(rows: DataFrame, out: str, checkpoint: str, name: str, once: bool) -> StreamingQuery:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    stream = rows.writeStream.format("parquet").outputMode("append").queryName(name)
    stream = stream.option("path", out).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()


def start_keyed_detection(
    events: DataFrame,
    rules: Sequence[Rule],
    alerts: str,
    checkpoint: str,
    created_at: Column | None = None,
    once: bool = False,
    bounds: Bounds = Bounds(),
    now: Column | None = None,
) -> StreamingQuery:
    """Run pattern and threshold rules on a stream of events; alerts are appended to ``alerts`` with their ``version``.

    Indicator rules are run by :func:`start_indicator_detection`. An alert of a threshold rule is given out again when a late row raises its count; an alert never
    ceases to be one, as rows only add to counts.
    """
    events = in_time(events, bounds, now)
    stamp = F.current_timestamp() if created_at is None else created_at
    found = signature_alerts(pattern_matches(events, rules).withColumn("version", F.lit(0).cast("long")), rules, stamp, "version")
    if any(r.threshold for r in enabled_of(rules, "threshold")):
        found = found.unionByName(signature_alerts(keyed_threshold_matches(events, rules), rules, stamp, "version"))
    return _running(found, alerts, checkpoint, "keyed_detection", once)


def start_indicator_detection(
    events: DataFrame,
    rules: Sequence[Rule],
    alerts: str,
    checkpoint: str,
    listed: DataFrame | None = None,
    created_at: Column | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Run indicator rules on a stream of events, each batch on its own, against their lists or the table ``listed``.

    The list may change between batches: each reads it anew. A repeated batch replaces its files.
    """
    stamp = F.current_timestamp() if created_at is None else created_at

    def process(batch: DataFrame, number: int) -> None:
        # The batch is read several times, and the list is joined to it as it is to a table.
        rows = written(batch, "indicator-batch")
        found = signature_alerts(indicator_matches(rows, rules, listed), rules, stamp)
        found.write.mode("overwrite").parquet(f"{alerts}/batch={number}")
        discard(rows)

    stream = events.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).queryName("indicators")
    return (stream.trigger(availableNow=True) if once else stream).start()


def _places(flows: np.ndarray, known: np.ndarray) -> np.ndarray:
    """For each of the flows its row among the known ones, -1 if it has none; both name each flow once, in two numbers."""
    both = np.concatenate([known, flows])
    order = np.lexsort((both[:, 1], both[:, 0]))  # stable, so a known flow comes just before its equal
    again = np.flatnonzero((both[order[1:]] == both[order[:-1]]).all(axis=1))
    out = np.full(len(flows), -1)
    out[order[again + 1] - len(known)] = order[again]
    return out


class FlowState(StatefulProcessor):
    """The statistics of the flows of one bucket, which continue their totals."""

    OUT = ["event_id", "flow_duration", "packets_per_second", "bytes_per_second", "version"]
    # Start, packets and bytes of a flow's settled rows (start NONE: there are none), and its last time.
    TOTALS = ["flow", "flow_2", "start", "packets", "bytes", "last"]
    NONE = np.iinfo(np.int64).min

    def __init__(self, idle_us: int):
        self.idle_us = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = _Rows(handle, 6)
        kinds = [T.StructField("flows", T.BinaryType()), T.StructField("version", T.LongType()), T.StructField("timer", T.LongType())]
        self.totals = handle.getValueState("totals", T.StructType(kinds))

    def _keep(self, totals: np.ndarray, version: int, timer: int | None) -> None:
        """Store the totals; the timer stands where the first flow will have been idle for long enough."""
        end = (int(totals[:, 5].min()) + self.idle_us) // 1000 + 1
        if timer is None or end < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(end)
            timer = end
        self.totals.update((totals.tobytes(), version, timer))

    def _totals(self) -> tuple[np.ndarray, int, int | None]:
        if not self.totals.exists():
            return np.zeros((0, len(self.TOTALS)), np.int64), 0, None
        flows, version, timer = self.totals.get()
        return np.frombuffer(flows, np.int64).reshape(-1, len(self.TOTALS)), version, timer

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = _numbers(rows, ["flow", "flow_2", "us", "event_id", "v_packets", "v_bytes"])
        old = self.rows.pieces()
        totals, version, timer = self._totals()
        known = np.concatenate([*old, new])
        order = np.lexsort((known[:, 3], known[:, 2], known[:, 1], known[:, 0]))
        known = known[order]
        # Rows of a flow are neighbours, in the order of their time.
        first = np.flatnonzero(np.concatenate([[True], (known[1:, :2] != known[:-1, :2]).any(axis=1)]))
        count = np.diff(np.append(first, len(known)))
        flow = np.repeat(np.arange(first.size), count)
        flows, us = known[first, :2], known[:, 2]
        at = _places(flows, totals[:, :2])
        past = np.full((first.size, 4), [self.NONE, 0, 0, self.NONE])
        past[at >= 0] = totals[at[at >= 0], 2:]
        start, size, fresh = past[:, 0], known[:, 4:], past[:, 0] == self.NONE
        upto = np.cumsum(size, axis=0) - size
        before = upto - upto[first][flow] + past[flow, 1:3]
        begun = np.where(fresh, us[first], start)
        seconds = (us - begun[flow]) / US
        rate = before / np.where(seconds > 0, seconds, np.inf)[:, None]
        out = pd.DataFrame(
            {"event_id": known[:, 3], "flow_duration": seconds, "packets_per_second": rate[:, 0], "bytes_per_second": rate[:, 1]}
        )
        # A flow's first event has none.
        out.loc[first[fresh], self.OUT[1:4]] = None
        out["version"] = version + 1
        # What comes after a flow's earliest new row changes.
        place = np.arange(len(known))
        earliest = np.minimum.reduceat(np.where(order >= len(known) - len(new), place, len(known)), first)
        changed = place >= earliest[flow]
        settled = us <= timerValues.getCurrentWatermarkInMs() * 1000
        some = np.logical_or.reduceat(settled, first)
        past[:, 0] = np.where(some, begun, start)
        past[:, 1:3] += np.add.reduceat(np.where(settled[:, None], size, 0), first, axis=0)
        past[:, 3] = np.maximum(past[:, 3], us[first + count - 1])
        if some.any():
            self.rows.replace(known[~settled])
        else:
            self.rows.add(new, old)
        others = np.ones(len(totals), bool)
        others[at[at >= 0]] = False
        self._keep(np.concatenate([totals[others], np.concatenate([flows, past], axis=1)]), version + 1, timer)
        yield out[changed][self.OUT]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        totals, version, _ = self._totals()
        idle = (totals[:, 5] + self.idle_us) // 1000 + 1 <= timerValues.getCurrentWatermarkInMs()
        if idle.any():
            known = np.concatenate([np.zeros((0, 6), np.int64), *self.rows.pieces()])
            flows, flow = np.unique(known[:, :2], axis=0, return_inverse=True)
            self.rows.replace(known[(_places(flows, totals[~idle, :2]) >= 0)[flow]])
        if idle.all():
            self.totals.clear()
        else:
            self._keep(totals[~idle], version, None)
        yield pd.DataFrame(columns=self.OUT)

    def close(self) -> None:
        pass


def start_keyed_flows(
    events: DataFrame,
    out: str,
    checkpoint: str,
    idle_seconds: int,
    once: bool = False,
    bounds: Bounds = Bounds(),
    now: Column | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Running statistics of a stream of network events by flow: event_id, duration, rates and ``version``.

    ``buckets`` must stay the same as long as the checkpoint is used.
    """
    rows = keyed(in_time(events, bounds, now)).select(
        F.xxhash64(*KEYS).alias("flow"),
        F.xxhash64(F.lit(1), *KEYS).alias("flow_2"),
        "us",
        "event_id",
        "v_packets",
        "v_bytes",
        "timestamp",
    )
    rows = rows.withColumn("bucket", F.pmod("flow", F.lit(buckets)).cast("int"))
    found = rows.groupBy("bucket").transformWithStateInPandas(
        FlowState(idle_seconds * US),
        "event_id long, flow_duration double, packets_per_second double, bytes_per_second double, version long",
        "Append",
        "EventTime",
    )
    return _running(found, out, checkpoint, "keyed_flows", once)


def start_refused(
    events: DataFrame, out: str, checkpoint: str, once: bool = False, bounds: Bounds = Bounds(), now: Column | None = None
) -> StreamingQuery:
    """Append undated rows and rows of the future to a side table; they move nothing."""
    return _running(out_of_time(events, bounds, now), out, checkpoint, "refused", once)
