"""Scaling of model scores and severity bands."""

from pyspark.sql import Column
from pyspark.sql import functions as F


# Lower ends of the severity bands, and the expected largest
# reconstruction error.
ANOMALY_BANDS = {"critical": 0.9, "high": 0.75, "medium": 0.6}
FUSION_BANDS = {"critical": 0.9, "high": 0.7, "medium": 0.5, "low": 0.3}
LARGEST_ERROR = 10.0


def _band(score: Column, bands: dict[str, float]) -> Column:
    arms = list(bands.items())
    out = F.when(score >= arms[0][1], arms[0][0])
    for name, low in arms[1:]:
        out = out.when(score >= low, name)
    return out


def unit(score: Column) -> Column:
    """Clamp to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def normalise(score: Column, model_type: Column) -> Column:
    """Score of a named model on [0, 1], as published (see ``forest_anomaly``)."""
    return (
        F.when(model_type == "isolation_forest", unit(F.lit(1.0) + score))
        .when(model_type == "one_class_svm", F.lit(1.0) / (F.lit(1.0) + F.exp(score)))
        .when(model_type == "autoencoder", unit(score / LARGEST_ERROR))
        .otherwise(F.lit(0.5))
    )


def forest_anomaly(score: Column) -> Column:
    """Forest score in [-1, 0], turned so that 1 is the most anomalous."""
    return unit(-score)


def anomaly_severity(score: Column) -> Column:
    """Band of a mean anomaly score, ``low`` below the others."""
    return _band(score, ANOMALY_BANDS).otherwise("low")


def fusion_severity(score: Column) -> Column:
    """Band of a fused signature and anomaly score; below the lowest, none."""
    return _band(score, FUSION_BANDS)
