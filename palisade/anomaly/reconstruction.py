"""Reconstruction error after a linear encoding (principal components).

The same interface as a 16-unit bottleneck network: fit on normal rows, score by
the mean squared error of what the bottleneck loses, flag above the 95th
percentile of the training errors.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import PCA, PCAModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.anomaly.prep import apply_scale, fit_scale


@dataclass
class ReconstructionModel:
    features: list[str]
    scale: dict[str, tuple[float, float]]
    pca: PCAModel
    threshold: float | None = None


def _assembled(df: DataFrame, features: Sequence[str], scale) -> DataFrame:
    return VectorAssembler(
        inputCols=list(features), outputCol="__x", handleInvalid="keep"
    ).transform(apply_scale(df, scale))


def _norm2(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v * v)


def train_reconstruction(
    df: DataFrame, features: Sequence[str], encoding_dim: int = 16, percentile: float = 0.95
) -> ReconstructionModel:
    """Fit on all given rows; the covariance has the size of the feature list."""
    names = list(features)
    scale = fit_scale(df, names)
    vectors = _assembled(df.select(*names), names, scale)
    k = min(encoding_dim, len(names))
    pca = PCA(k=k, inputCol="__x", outputCol="__code").fit(vectors)
    model = ReconstructionModel(names, scale, pca)
    model.threshold = score_reconstruction(df.select(*names), model).agg(
        F.percentile_approx("error", percentile, 10_000)
    ).first()[0]
    return model


def score_reconstruction(df: DataFrame, model: ReconstructionModel) -> DataFrame:
    """Add ``error`` (mean squared residual) and, once fitted, ``is_anomaly``.

    The components are orthonormal and the scaled data is centred, so the residual
    is the squared length that the code does not carry.
    """
    names = model.features
    wide = df.select("*", *[F.col(c).alias(f"__raw_{i}") for i, c in enumerate(df.columns)])
    coded = model.pca.transform(_assembled(wide, names, model.scale))
    residual = _norm2(vector_to_array("__x")) - _norm2(vector_to_array("__code"))
    out = coded.select(
        *[F.col(f"__raw_{i}").alias(c) for i, c in enumerate(df.columns)],
        (F.greatest(residual, F.lit(0.0)) / len(names)).alias("error"),
    )
    if model.threshold is None:
        return out
    return out.withColumn("is_anomaly", (F.col("error") > F.lit(model.threshold)).cast("int"))
