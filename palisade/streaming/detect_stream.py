"""Detection on event streams.

Pattern rules and windowed counts are ordinary streaming plans. Threshold rules
need every row's exact trailing count, so each micro-batch is joined with the
stored rows around it and goes through the batch operator: batch and stream share
one definition, and a hot key is cut the same way. Rows may come in any order within
a stated lateness.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from palisade.functions.timestamps import micros
from palisade.operators.alerts import signature_alerts
from palisade.rules.compile import rule_column
from palisade.rules.matching import enabled_of, stateless_matches, threshold_matches
from palisade.rules.model import Rule
from palisade.streaming.state import Bounds, accept, forget_before, keep, kept

US = 1_000_000


def read_event_files(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    glob: str = "*.parquet",
    files_per_batch: int = 100,
) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def windowed_counts(
    events: DataFrame, keys: Sequence[str], length: str, slide: str | None, late: str
) -> DataFrame:
    """Events per key and (sliding) window; rows later than ``late`` are dropped.
    Spark combines counts before the shuffle, so a hot key costs one row per task."""
    return (
        events.withWatermark("timestamp", late)
        .groupBy(F.window("timestamp", length, slide).alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select("w.start", "w.end", *keys, "n_events")
    )


def start_sessions(
    events: DataFrame,
    keys: Sequence[str],
    gap_seconds: int,
    sums: Mapping[str, Column],
    out: str,
    checkpoint: str,
    late_seconds: int,
    once: bool = False,
) -> StreamingQuery:
    """Append (keys, start, end, sums) of every session to ``out`` once no accepted row can change it.

    A row that comes late, but not later than stated, joins the sessions on both sides of it. Sessions
    are merged before the shuffle too, so a busy key costs a few rows a task.
    """
    events.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    found = (
        events.withWatermark("timestamp", f"{late_seconds} seconds")
        .groupBy(F.session_window("timestamp", f"{gap_seconds} seconds").alias("w"), *keys)
        .agg(*[value.alias(name) for name, value in sums.items()])
        .select(*keys, "w.start", "w.end", *sums)
    )
    stream = found.writeStream.format("parquet").outputMode("append").option("path", out)
    stream = stream.option("checkpointLocation", checkpoint).queryName("sessions")
    return (stream.trigger(availableNow=True) if once else stream).start()


def latest(out: DataFrame, key: str, version: str = "batch") -> DataFrame:
    """What a stream has stored, in its newest version: a late row writes the rows that
    it changes once more, with a higher ``version``."""
    rest = [c for c in out.columns if c not in (key, version)]
    newest = F.max_by(F.struct(*rest), version).alias("row")
    return out.groupBy(key).agg(newest).select(key, "row.*")


def trailing_writer(
    operator: Callable[[DataFrame], DataFrame],
    window_seconds: int,
    out: str,
    state: str,
    bounds: Bounds = Bounds(),
    counted: Callable[[DataFrame], DataFrame] | None = None,
    stateless: Callable[[DataFrame], DataFrame] | None = None,
    now: Column | None = None,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that runs a batch operator over the batch and the stored
    rows around it.

    ``operator`` returns rows with ``event_id`` and looks back at most the window. A row can
    change results from its own time to one window later, so that span is computed again from
    the stored rows of one more window, and appended to ``out/batch=<n>``; :func:`latest`
    reads the newest. ``counted`` picks the rows and columns that the operator needs and that
    are stored; ``stateless`` gives further results of the batch alone. See
    :mod:`palisade.streaming.state` for what is refused. Repeating a batch rewrites its files.
    """
    span = max(60, window_seconds, bounds.late_seconds // 16)
    width = window_seconds * US

    def process(batch: DataFrame, number: int) -> None:
        events = batch.persist()  # read several times; recomputed from the source if lost
        spark = events.sparkSession
        got = accept(events, number, state, bounds, now)
        rows = got.rows if counted is None else counted(got.rows)
        first, last = (0, 0) if got.first is None else (got.first, got.last)
        stored = kept(spark, state, rows.schema, span, first - width, last + width, number)
        known = stored.unionByName(rows)
        time = micros(F.col("timestamp"))
        touched = known.where((time >= first) & (time < last + max(width, 1))).select("event_id")
        fresh = operator(known).join(touched, "event_id", "left_semi")
        if stateless is not None:
            fresh = fresh.unionByName(stateless(got.rows))
        fresh.write.mode("overwrite").parquet(f"{out}/batch={number}")
        keep(rows, number, state, span)
        if got.horizon is not None:
            forget_before(spark, state, span, got.horizon - width)
        events.unpersist()

    return process


def alert_writer(
    rules: Sequence[Rule],
    alerts: str,
    state: str,
    created_at: Column | None = None,
    bounds: Bounds = Bounds(),
    now: Column | None = None,
) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function of detection: alerts of each batch.

    Pattern and indicator rules see the batch alone. For threshold rules only the rows that
    some rule counts are stored, and of them only the columns that the rules name.
    """
    thresholds = enabled_of(rules, "threshold")
    longest = max((r.time_window_seconds for r in thresholds), default=0)
    named = {"event_id", "timestamp", "event_type", "dst_port"}
    for r in thresholds:
        named |= {r.grouping_key.split(".")[0], *(c.field.split(".")[0] for c in r.conditions)}

    def alerts_of(matches: DataFrame) -> DataFrame:
        return signature_alerts(matches, rules, F.current_timestamp() if created_at is None else created_at)

    def counted(events: DataFrame) -> DataFrame:
        some = reduce(lambda a, b: a | b, [rule_column(events, r) for r in thresholds], F.lit(False))
        return events.where(some).select(*[c for c in events.columns if c in named])

    return trailing_writer(
        lambda known: alerts_of(threshold_matches(known, thresholds)),
        longest,
        alerts,
        state,
        bounds,
        counted,
        lambda batch: alerts_of(stateless_matches(batch, rules)),
        now,
    )


def _started(events: DataFrame, writer, checkpoint: str, name: str | None, once: bool) -> StreamingQuery:
    stream = events.writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint)
    if name:
        stream = stream.queryName(name)
    return (stream.trigger(availableNow=True) if once else stream).start()


def start_trailing(
    events: DataFrame,
    operator: Callable[[DataFrame], DataFrame],
    window_seconds: int,
    out: str,
    state: str,
    checkpoint: str,
    once: bool = False,
    bounds: Bounds = Bounds(),
) -> StreamingQuery:
    """Run an operator with a bounded look-back, such as host behaviour, on a stream."""
    return _started(events, trailing_writer(operator, window_seconds, out, state, bounds), checkpoint, None, once)


def start_detection(
    events: DataFrame,
    rules: Sequence[Rule],
    alerts: str,
    state: str,
    checkpoint: str,
    created_at: Column | None = None,
    once: bool = False,
    bounds: Bounds = Bounds(),
) -> StreamingQuery:
    """Run all rules on a stream of events."""
    return _started(events, alert_writer(rules, alerts, state, created_at, bounds), checkpoint, "detection", once)


def flow_state_writer(
    out: str, state: str, idle_seconds: int, bounds: Bounds = Bounds(), now: Column | None = None
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for running flow statistics.

    Rows are stored until they are older than any row still accepted; then they become part
    of their flow's totals (start, last seen, packets, bytes). A batch computes its flows
    from the totals and the stored rows, and appends what it changes; :func:`latest` reads
    the newest. Flows of which only totals are left are forgotten after ``idle_seconds``.
    """
    from palisade.operators.flow_state import KEYS, flow_batch, flow_totals, keyed

    span = max(60, bounds.late_seconds // 16)
    far = 1 << 60

    def totals(spark: SparkSession, number: int) -> DataFrame | None:
        return spark.read.parquet(f"{state}/flows/batch={number}") if number >= 0 else None

    def process(batch: DataFrame, number: int) -> None:
        events = batch.persist()  # read several times; recomputed from the source if lost
        spark = events.sparkSession
        got = accept(events, number, state, bounds, now)
        before = totals(spark, number - 1) if number else None
        # Rows that nothing can come before any more go into the totals first.
        settled = -far if got.horizon is None else got.horizon // (span * US) * span * US
        if number:
            done = spark.read.parquet(f"{state}/folded/batch={number - 1}").first()["us"]
        else:
            done = -far
        settled = max(settled, done)
        old = kept(spark, state, events.schema, span, done, settled, number)
        flow_totals(old, before, settled - idle_seconds * US).write.mode("overwrite").parquet(
            f"{state}/flows/batch={number}"
        )
        spark.createDataFrame([(settled,)], "us long").coalesce(1).write.mode("overwrite").parquet(
            f"{state}/folded/batch={number}"
        )
        stored = kept(spark, state, events.schema, span, settled, far, number)
        own = keyed(got.rows).select(*KEYS).distinct()
        known = keyed(stored).join(own, KEYS, "left_semi").select(*events.columns).unionByName(got.rows)
        fresh = flow_batch(known, totals(spark, number))
        if got.first is not None:
            fresh = fresh.where(micros(F.col("timestamp")) >= got.first)
        fresh.write.mode("overwrite").parquet(f"{out}/batch={number}")
        keep(got.rows, number, state, span)
        # Safe also if this batch is repeated: it starts from the totals of the last one.
        if done > -far:
            forget_before(spark, state, span, done)
        for old_name in (f"flows/batch={number - 2}", f"folded/batch={number - 2}"):
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/{old_name}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        events.unpersist()

    return process


def start_flow_statistics(
    events: DataFrame,
    out: str,
    state: str,
    checkpoint: str,
    idle_seconds: int,
    once: bool = False,
    bounds: Bounds = Bounds(),
) -> StreamingQuery:
    """Running flow statistics on a stream of network events."""
    return _started(events, flow_state_writer(out, state, idle_seconds, bounds), checkpoint, "flow_statistics", once)
