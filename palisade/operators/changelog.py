"""Current state of tables kept as append-only change rows, and the compaction of such logs.

A fold reads each key's newest or oldest row that meets some condition. Those rows are the fold's witnesses:
a log of the witnesses alone folds to the same, also together with any rows that come later. So a
snapshot is a shorter log in the same layout, a few rows a key, and needs no fold of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latest_filled(column: str, order: Column) -> Column:
    """The newest non-NULL value."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), order))


def current_rules(changes: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Rule table from (signature_id, seq, op, enabled, attributes...).

    ``op`` is add, update, delete, enable or disable. Rules that were never added
    or were deleted are absent; a switch changes only ``enabled``; an attribute
    left NULL by an update keeps its value.
    """
    seq = F.col("seq")
    op = F.col("op")
    switched = F.when(op == "enable", True).when(op == "disable", False).otherwise(F.col("enabled"))
    rows = changes.withColumn("__enabled", switched)
    folded = rows.groupBy("signature_id").agg(
        *[latest_filled(a, seq).alias(a) for a in attributes],
        F.coalesce(latest_filled("__enabled", seq), F.lit(True)).alias("enabled"),
        F.max((op == "add").cast("int")).alias("__added"),
        F.max((op == "delete").cast("int")).alias("__deleted"),
    )
    return folded.where("__added = 1 AND __deleted = 0").drop("__added", "__deleted")


def missing_rules(candidates: DataFrame, loaded: DataFrame) -> DataFrame:
    """Candidate rules whose name is not loaded yet."""
    return candidates.join(loaded.select("name"), "name", "left_anti")


def load_counts(candidates: DataFrame, loaded: DataFrame) -> DataFrame:
    """(loaded, skipped) of a load that skips existing names."""
    known = loaded.select("name").distinct().withColumn("__known", F.lit(True))
    joined = candidates.join(known, "name", "left")
    return joined.agg(
        F.count_if(F.col("__known").isNull()).alias("loaded"),
        F.count_if(F.col("__known").isNotNull()).alias("skipped"),
    )


def last_matched(alerts: DataFrame) -> DataFrame:
    """Newest alert time per rule."""
    return (
        alerts.where(F.col("signature_id").isNotNull())
        .groupBy("signature_id")
        .agg(F.max("created_at").alias("last_matched"))
    )


def alert_states(changes: DataFrame) -> DataFrame:
    """Alert status from (alert_id, seq, at, status, notes), newest change last."""
    seq, status = F.col("seq"), F.col("status")
    closing = status.isin("resolved", "false_positive")
    return changes.groupBy("alert_id").agg(
        F.max_by("status", seq).alias("status"),
        F.max_by("at", F.when(status == "investigating", seq)).alias("investigated_at"),
        F.max_by("at", F.when(closing, seq)).alias("resolved_at"),
        F.coalesce(
            F.max_by(status == "false_positive", F.when(closing, seq)), F.lit(False)
        ).alias("false_positive"),
        F.max_by("notes", F.when(F.col("notes") != "", seq)).alias("resolution_notes"),
        F.max_by("at", seq).alias("updated_at"),
    )


def apply_states(alerts: DataFrame, states: DataFrame) -> DataFrame:
    """Alerts with their current status; those never changed stay as they are."""
    changed = [c for c in states.columns if c != "alert_id"]
    renamed = states.select("alert_id", *[F.col(c).alias(f"__{c}") for c in changed])
    joined = alerts.join(renamed, "alert_id", "left")
    return joined.select(
        *[
            F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in changed else F.col(c)
            for c in alerts.columns
        ]
    )


def unknown_alerts(changes: DataFrame, alerts: DataFrame) -> DataFrame:
    """Changes that name an alert that does not exist (to be reported as errors)."""
    return changes.join(alerts.select("alert_id"), "alert_id", "left_anti")


def current_iocs(rows: DataFrame) -> DataFrame:
    """Indicator table from sightings (seq, at, op, ioc_type, value, ...).

    ``op`` is ``seen`` or ``deactivate``. The first sighting sets the descriptive
    fields; later ones move ``last_seen``, set the confidence if they carry one,
    and make the indicator active again unless they say otherwise. Rows without
    type or value are skipped.
    """
    seq, seen = F.col("seq"), F.col("op") == "seen"
    usable = rows.where(F.col("ioc_type").isNotNull() & F.col("value").isNotNull()).withColumn(
        "__active",
        F.when(seen, F.coalesce(F.col("is_active"), F.lit(True))).otherwise(F.lit(False)),
    )
    when_seen = F.when(seen, seq)

    def kept(name: str) -> Column:
        # A change log of people need not describe or tag anything.
        value = F.col(name) if name in rows.columns else F.lit(None).cast("string")
        return F.min_by(value, when_seen).alias(name)

    folded = usable.groupBy("ioc_type", "value").agg(
        kept("threat_type"),
        kept("severity"),
        kept("description"),
        kept("tags"),
        F.coalesce(F.min_by("source", when_seen), F.lit("manual")).alias("source"),
        F.coalesce(
            F.max_by("confidence", F.when(seen & F.col("confidence").isNotNull(), seq)),
            F.lit(0.5),
        ).alias("confidence"),
        F.max_by("__active", seq).alias("is_active"),
        F.min(F.when(seen, F.col("at"))).alias("first_seen"),
        F.max(F.when(seen, F.col("at"))).alias("last_seen"),
    )
    return folded.where(F.col("first_seen").isNotNull())


def feed_counts(rows: DataFrame) -> DataFrame:
    """Indicators taken from each feed (rows without type or value do not count)."""
    usable = F.col("ioc_type").isNotNull() & F.col("value").isNotNull()
    return rows.groupBy("source").agg(F.count_if(usable).alias("n_iocs"))


def registry(models: DataFrame) -> DataFrame:
    """Every trained model; only the newest of its type is active."""
    newest = models.groupBy("model_type").agg(F.max("seq").alias("__newest"))
    return (
        models.join(newest, "model_type")
        .withColumn("is_active", F.col("seq") == F.col("__newest"))
        .drop("__newest")
    )


def active_models(models: DataFrame) -> DataFrame:
    """The newest model of every type, in one aggregation."""
    rest = [c for c in models.columns if c != "model_type"]
    return (
        models.groupBy("model_type")
        .agg(F.max_by(F.struct(*rest), "seq").alias("m"))
        .select("model_type", "m.*")
    )


@dataclass(frozen=True)
class Witness:
    """The row with the largest (or least) ``order`` among those that meet the condition."""

    order: str
    condition: Column
    newest: bool = True


RULE_KEYS, STATE_KEYS, IOC_KEYS = ("signature_id",), ("alert_id",), ("ioc_type", "value")


def rule_witnesses(attributes: Sequence[str]) -> list[Witness]:
    """What :func:`current_rules` reads."""
    op = F.col("op")
    switch = F.col("enabled").isNotNull() | op.isin("enable", "disable")
    return [
        *[Witness("seq", F.col(a).isNotNull()) for a in attributes],
        Witness("seq", switch),
        Witness("seq", op == "add"),
        Witness("seq", op == "delete"),
    ]


def state_witnesses() -> list[Witness]:
    """What :func:`alert_states` reads."""
    status = F.col("status")
    return [
        Witness("seq", F.lit(True)),
        Witness("seq", status == "investigating"),
        Witness("seq", status.isin("resolved", "false_positive")),
        Witness("seq", F.col("notes") != ""),
    ]


def ioc_witnesses() -> list[Witness]:
    """What :func:`current_iocs` reads."""
    seen = F.col("op") == "seen"
    return [
        Witness("seq", seen, False),
        Witness("seq", seen & F.col("confidence").isNotNull()),
        Witness("seq", F.lit(True)),
        Witness("at", seen, False),
        Witness("at", seen),
    ]


def witnesses(rows: DataFrame, keys: Sequence[str], wanted: Sequence[Witness]) -> DataFrame:
    """The rows that a fold by ``keys`` depends on, in one aggregation."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    picked = [(F.max_by if w.newest else F.min_by)(whole, F.when(w.condition, F.col(w.order))) for w in wanted]
    kept = F.array_distinct(F.array_compact(F.array(*picked)))
    return rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(kept.alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def append_changes(rows: DataFrame, path: str, batch: int) -> None:
    """Add a batch of change rows to the log at ``path``; a repeated batch replaces itself."""
    rows.write.mode("overwrite").parquet(f"{path}/log/batch={batch}")


def _stored(spark: SparkSession, path: str, schema: T.StructType, part: str) -> DataFrame | None:
    """A table in folders by number, None if there is none yet."""
    try:
        return spark.read.schema(T.StructType([*schema.fields, T.StructField(part, T.IntegerType())])).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_changes(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The newest snapshot and the batches after it; other folders are not opened."""
    return _since_snapshot(spark, path, schema)[0]


def _since_snapshot(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, int]:
    """The rows to fold, and the last batch among them."""
    snapshots = _stored(spark, f"{path}/snapshots", schema, "upto")
    upto = -1 if snapshots is None else _largest(snapshots, "upto")
    log = _stored(spark, f"{path}/log", schema, "batch")
    if log is None:
        return spark.createDataFrame([], schema), upto
    tail = log.where(F.col("batch") > upto).drop("batch")
    last = max(upto, _largest(log, "batch"))
    if snapshots is None:
        return tail, last
    return snapshots.where(F.col("upto") == upto).drop("upto").unionByName(tail), last


def _largest(stored: DataFrame, part: str) -> int:
    """The largest folder number, from the names of the files alone."""
    names = [f.rsplit(f"/{part}=", 1)[1].split("/")[0] for f in stored.inputFiles() if f"/{part}=" in f]
    return max(map(int, names), default=-1)


def compact(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], wanted: Sequence[Witness]) -> int:
    """Write a snapshot of everything up to the last batch, reading the one before and what came
    after; returns that batch's number. Rows with a null key are kept apart like any other key."""
    rows, last = _since_snapshot(spark, path, schema)
    witnesses(rows, keys, wanted).write.mode("overwrite").parquet(f"{path}/snapshots/upto={last}")
    return last
