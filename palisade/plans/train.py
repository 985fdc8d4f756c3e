"""Training, storing and scoring of the anomaly models."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.anomaly.evaluate import evaluate
from palisade.anomaly.forest import score_forest, train_forest
from palisade.anomaly.kernel import score_kernel, train_kernel
from palisade.anomaly.prep import (
    Preparation,
    benign_split,
    binary_label,
    fit_preparation,
    sample_rows,
)
from palisade.anomaly.reconstruction import score_reconstruction, train_reconstruction
from palisade.anomaly.store import load_model, save_model
from palisade.functions.scores import LARGEST_ERROR, forest_anomaly, unit
from palisade.operators.alerts import anomaly_alerts, mean_score, to_alert_schema
from palisade.operators.changelog import active_models
from palisade.operators.features import stored_features
from palisade.operators.reports import anomaly_statistics
from palisade.schemas import MODEL_SCHEMA
from palisade.session import written
from palisade.sources.datasets import ROW_ID, column_kinds, named_set
from palisade.sources.sinks import stored_table, write_alerts

log = logging.getLogger(__name__)

MODEL_TYPES = ("isolation_forest", "one_class_svm", "autoencoder")
MODEL_NAMES = {
    "isolation_forest": "Isolation Forest",
    "one_class_svm": "One-Class SVM",
    "autoencoder": "Autoencoder",
}


@dataclass
class Prepared:
    """Train and test rows with all features numeric and scaled, and how they came
    about. Columns: the row id, ``label`` and the features."""

    train: DataFrame
    test: DataFrame
    steps: Preparation

    @property
    def features(self) -> list[str]:
        return self.steps.features


def prepare(
    df: DataFrame,
    label: str,
    row_id: str,
    numbers: Sequence[str],
    texts: Sequence[str] = (),
    sample_size: int | None = None,
) -> Prepared:
    """Split benign-only, fit every step on the training rows, apply to both.

    The input is written down once: fitting reads it several times, and features
    often come out of windows that should not run again for each step. So is the
    result.
    """
    columns = df.select(
        row_id,
        binary_label(F.col(label)).alias("label"),
        *[F.col(c).try_cast("double").alias(c) for c in numbers],
        *[F.col(c).cast("string").alias(c) for c in texts],
    )
    base = written(columns, "features")
    if sample_size:
        base = sample_rows(base, row_id, sample_size)
    marked = benign_split(base, "label", row_id)
    steps = fit_preparation(marked.where("split = 'train'"), row_id, numbers, texts)
    # Training and measuring pass over the result many times.
    ready = written(steps.apply(marked, row_id, ["label", "split"]), "ready")
    train_rows, test_rows = (ready.where(F.col("split") == s).drop("split") for s in ("train", "test"))
    return Prepared(train_rows, test_rows, steps)


def train(model_type: str, data: Prepared, row_id: str):
    """Fit one of the model types on the training rows."""
    if model_type == "isolation_forest":
        return train_forest(data.train, data.features, row_id)
    if model_type == "one_class_svm":
        return train_kernel(data.train, data.features)
    if model_type == "autoencoder":
        return train_reconstruction(data.train, data.features)
    raise ValueError(f"unknown model type {model_type!r}")


def score(model_type: str, model, df: DataFrame) -> DataFrame:
    """Add ``<model_type>`` (score on [0, 1], 1 most anomalous) and ``is_anomaly``."""
    if model_type == "isolation_forest":
        out = score_forest(df, model).withColumnRenamed("score", "__raw")
        return out.withColumn(model_type, forest_anomaly(-F.col("__raw"))).drop("__raw")
    if model_type == "one_class_svm":
        out = score_kernel(df, model)
        return (
            out.withColumn(model_type, 1.0 / (1.0 + F.exp("decision")))
            .withColumn("is_anomaly", (F.col("decision") < 0).cast("int"))
            .drop("decision")
        )
    if model_type == "autoencoder":
        out = score_reconstruction(df, model)
        return out.withColumn(model_type, unit(F.col("error") / LARGEST_ERROR)).drop("error")
    raise ValueError(f"unknown model type {model_type!r}")


def metrics_on_test(model_type: str, model, data: Prepared) -> DataFrame:
    """Metrics on the test rows as one row."""
    return evaluate(score(model_type, model, data.test), "label", "is_anomaly")


def score_all(models: dict[str, object], df: DataFrame) -> DataFrame:
    """Scores of several models side by side and the map of them."""
    for name, model in models.items():
        df = score(name, model, df).drop("is_anomaly")
    return df.withColumn("scores", scores_map(list(models)))


def scores_map(names: Sequence[str]) -> Column:
    return F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])


def train_and_register(
    data: Prepared, row_id: str, model_type: str, folder: str, dataset: str
) -> dict[str, object]:
    """Train, measure and store a model, and append it to the registry of the folder.

    The newest model of a type is the active one, so nothing has to be switched off.
    """
    spark = data.train.sparkSession
    model = train(model_type, data, row_id)
    metrics = metrics_on_test(model_type, model, data).first().asDict()
    stamp = spark.sql("SELECT unix_micros(current_timestamp())").first()[0]
    path = f"{folder}/{model_type}-{stamp}"
    save_model(spark, path, model_type, model, data.steps)
    n_train, n_test = data.train.count(), data.test.count()
    row = {
        "seq": stamp,
        "name": MODEL_NAMES[model_type],
        "version": str(stamp),
        "model_type": model_type,
        "file_path": path,
        "parameters": {"features": ",".join(data.features)},
        "training_dataset": dataset,
        "training_samples": n_train,
        "validation_accuracy": metrics["accuracy"],
        "precision": metrics["precision"],
        "recall": metrics["recall"],
        "f1_score": metrics["f1_score"],
        "false_positive_rate": metrics["false_positive_rate"],
    }
    table = spark.createDataFrame(
        [tuple(row.get(f.name) for f in MODEL_SCHEMA)], MODEL_SCHEMA
    ).withColumns({c: F.timestamp_micros("seq") for c in ("training_date", "deployed_at")})
    table.write.mode("append").parquet(f"{folder}/registry")
    return {
        "model_path": path, "metrics": metrics, "training_samples": n_train, "test_samples": n_test
    }


def train_from_set(
    spark: SparkSession, name: str, path: str, model_type: str, folder: str, sample_size: int | None = None
) -> dict[str, object]:
    """Train a model on a published set and register it; which features are numbers and which are
    categories is seen from the data."""
    table = written(named_set(spark, name, path, sample_size), "training-set")
    numbers, texts = column_kinds(table)
    data = prepare(table, "label", ROW_ID, numbers, texts)
    return train_and_register(data, ROW_ID, model_type, folder, name)


def read_registry(spark: SparkSession, folder: str) -> DataFrame:
    stored = stored_table(spark, f"{folder}/registry", MODEL_SCHEMA)
    return spark.createDataFrame([], MODEL_SCHEMA) if stored is None else stored


def load_active(spark: SparkSession, folder: str) -> dict[str, tuple[object, Preparation]]:
    """Model and preparation steps of every active type; one registry row per type. A model that can't be
    read is reported and left out."""
    rows = active_models(read_registry(spark, folder)).collect()
    known = [r for r in rows if r["model_type"] in MODEL_TYPES]
    out = {}
    for r in sorted(known, key=lambda r: MODEL_TYPES.index(r["model_type"])):
        try:
            out[r["model_type"]] = load_model(spark, r["file_path"], r["model_type"])
        except (PySparkException, Py4JError, KeyError, TypeError, ValueError) as error:
            # The others go on scoring.
            log.error("%s can't be read from %s: %s", r["model_type"], r["file_path"], error)
    return out


def score_events(
    features: DataFrame, row_id: str, models: dict[str, tuple[object, Preparation]]
) -> DataFrame:
    """(row id, one score per active model, map of the scores).

    Models that share their preparation share one pass over it. Those that want features which the events
    don't have are reported and left out.
    """
    out, shared, used = None, {}, []
    for name, (model, steps) in models.items():
        shared.setdefault(steps.key(), (steps, {}))[1][name] = model
    for steps, group in shared.values():
        missing = sorted({*steps.numbers, *steps.texts} - set(features.columns))
        if missing:
            log.error("%s can't score events without %s", ", ".join(group), ", ".join(missing))
            continue
        ready = steps.apply(features, row_id)
        scored = score_all(group, ready).select(row_id, *group)
        out = scored if out is None else out.join(scored, row_id)
        used += group
    if out is None:
        raise ValueError("no active model")
    return out.withColumn("scores", scores_map([n for n in models if n in used]))


def detect_anomalies(
    features: DataFrame,
    models: dict[str, tuple[object, Preparation]],
    created_at: Column,
    threshold: float = 0.5,
) -> DataFrame:
    """Anomaly alerts of events given as feature rows with ``event_id``."""
    scored = score_events(features, "event_id", models)
    return anomaly_alerts(scored, F.col("scores"), created_at, threshold)


def score_and_store(
    events: DataFrame, path: str, folder: str, created_at: Column | None = None, threshold: float = 0.5
) -> DataFrame:
    """Score stored events with the active models of ``folder``, append new alerts to the table at ``path``, and report
    the run: events processed, anomalies detected, alerts generated.

    Network and host events are scored alike; features that an event's type lacks are filled as in
    training. Scores are written once, so alerts and counts see the same.
    """
    models = load_active(events.sparkSession, folder)
    stamp = F.current_timestamp() if created_at is None else created_at
    scored = written(score_events(stored_features(events), "event_id", models), "run-scores")
    alerts = anomaly_alerts(scored, F.col("scores"), stamp, threshold)
    times = events.select("event_id", F.col("timestamp").alias("event_time"))
    write_alerts(to_alert_schema(alerts.drop("event_time").join(times, "event_id", "left")), path)
    return anomaly_statistics(scored.select(mean_score(F.col("scores")).alias("mean")), "mean", threshold)
