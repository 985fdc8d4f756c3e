"""Confusion counts and the metrics made from them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def evaluate(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Accuracy, precision, recall, F1, false-positive rate and the four counts, in
    one pass; an empty denominator gives 0."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    counts = df.agg(
        F.count_if(y & p).alias("true_positives"),
        F.count_if(~y & ~p).alias("true_negatives"),
        F.count_if(~y & p).alias("false_positives"),
        F.count_if(y & ~p).alias("false_negatives"),
    )
    tp, tn = F.col("true_positives"), F.col("true_negatives")
    fp, fn = F.col("false_positives"), F.col("false_negatives")
    return counts.select(
        "*",
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        _ratio(fp, fp + tn).alias("false_positive_rate"),
    )
