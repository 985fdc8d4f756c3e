"""Models and their preparation steps on Parquet.

A model is small: its size is set by its parameters. Categories of text features are a
table of their own, as they come from the data.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml.feature import PCAModel
from pyspark.sql import SparkSession

from palisade.anomaly.forest import NODE_DDL, Forest
from palisade.anomaly.kernel import KernelModel
from palisade.anomaly.prep import Preparation
from palisade.anomaly.reconstruction import ReconstructionModel


def _write_note(spark: SparkSession, path: str, note: dict) -> None:
    spark.createDataFrame([(json.dumps(note),)], "note string").write.parquet(path)


def _read_note(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.parquet(path).first()["note"])


def save_preparation(spark: SparkSession, path: str, steps: Preparation) -> None:
    for name, table in steps.classes.items():
        table.write.parquet(f"{path}/classes/{name}")
    note = {"numbers": steps.numbers, "texts": steps.texts, "fill": steps.fill, "scale": steps.scale}
    _write_note(spark, f"{path}/steps", note)


def load_preparation(spark: SparkSession, path: str) -> Preparation:
    note = _read_note(spark, f"{path}/steps")
    classes = {c: spark.read.parquet(f"{path}/classes/{c}") for c in note["texts"]}
    scale = {c: tuple(v) for c, v in note["scale"].items()}
    return Preparation(note["numbers"], note["texts"], note["fill"], classes, scale)


def save_model(
    spark: SparkSession, path: str, model_type: str, model, steps: Preparation
) -> None:
    save_preparation(spark, path, steps)
    if model_type == "isolation_forest":
        nodes = [tuple(r) for r in model.nodes.astype(object).itertuples(index=False)]
        spark.createDataFrame(nodes, NODE_DDL).write.parquet(f"{path}/nodes")
        note = {"features": model.features, "sample_size": model.sample_size, "cut": model.cut}
    elif model_type == "one_class_svm":
        note = {
            "features": model.features,
            "directions": model.directions.tolist(),
            "shifts": model.shifts.tolist(),
            "mean": model.mean.tolist(),
            "offset": model.offset,
        }
    elif model_type == "autoencoder":
        model.pca.write().save(f"{path}/pca")
        note = {"features": model.features, "scale": model.scale, "threshold": model.threshold}
    else:
        raise ValueError(f"unknown model type {model_type!r}")
    _write_note(spark, f"{path}/model", note)


def load_model(spark: SparkSession, path: str, model_type: str) -> tuple[object, Preparation]:
    steps = load_preparation(spark, path)
    note = _read_note(spark, f"{path}/model")
    if model_type == "isolation_forest":
        nodes = spark.read.parquet(f"{path}/nodes").toPandas()
        model = Forest(note["features"], nodes, note["sample_size"], note["cut"])
    elif model_type == "one_class_svm":
        model = KernelModel(
            note["features"],
            np.array(note["directions"]),
            np.array(note["shifts"]),
            np.array(note["mean"]),
            note["offset"],
        )
    elif model_type == "autoencoder":
        scale = {c: tuple(v) for c, v in note["scale"].items()}
        pca = PCAModel.load(f"{path}/pca")
        model = ReconstructionModel(note["features"], scale, pca, note["threshold"])
    else:
        raise ValueError(f"unknown model type {model_type!r}")
    return model, steps
