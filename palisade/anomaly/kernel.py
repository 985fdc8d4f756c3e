"""One-class kernel scorer.

Random Fourier features (Rahimi and Recht 2007) turn the RBF kernel into a dot
product, so "similarity to the training set" is a dot product with the mean
feature vector. That is the one-class machine with all training rows as support;
``nu`` keeps its meaning as the share of training rows below zero.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class KernelModel:
    features: list[str]
    directions: np.ndarray
    shifts: np.ndarray
    mean: np.ndarray
    offset: float = 0.0


def _embed(x: np.ndarray, directions: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    return np.sqrt(2.0 / len(shifts)) * np.cos(x @ directions + shifts)


def train_kernel(
    df: DataFrame,
    features: Sequence[str],
    nu: float = 0.1,
    gamma: float | None = None,
    n_components: int = 256,
    seed: int = 42,
) -> KernelModel:
    """Mean embedding in one pass; each batch sends one partial sum."""
    names = list(features)
    gamma = 1.0 / len(names) if gamma is None else gamma
    rng = np.random.default_rng(seed)
    directions = rng.normal(0.0, np.sqrt(2.0 * gamma), (len(names), n_components))
    shifts = rng.uniform(0.0, 2.0 * np.pi, n_components)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(n_components), 0
        for rows in batches:
            z = _embed(rows[names].to_numpy(dtype=float), directions, shifts)
            total += z.sum(axis=0)
            n += len(z)
        yield pd.DataFrame({"n": [n] * n_components, "i": range(n_components), "s": total})

    sums = (
        df.select(*names)
        .mapInPandas(partial, "n LONG, i INT, s DOUBLE")
        .groupBy("i")
        .agg((F.sum("s") / F.sum("n")).alias("mean"))
        .orderBy("i")
        .collect()  # n_components rows
    )
    model = KernelModel(names, directions, shifts, np.array([r["mean"] for r in sums]))
    model.offset = score_kernel(df.select(*names), model).agg(
        F.percentile_approx("decision", nu, 10_000)
    ).first()[0]
    return model


def score_kernel(df: DataFrame, model: KernelModel) -> DataFrame:
    """Add ``decision``; negative means anomalous."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # size set by the parameters

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for rows in batches:
            z = _embed(rows[m.features].to_numpy(dtype=float), m.directions, m.shifts)
            rows = rows.copy()
            rows["decision"] = z @ m.mean - m.offset
            yield rows

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(add, f"{ddl}, decision DOUBLE")
