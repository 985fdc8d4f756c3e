"""One event following another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.timestamps import micros
from palisade.operators.running import Measure, running

US = 1_000_000


def followed_by(
    events: DataFrame, keys: Sequence[str], first: Column, second: Column, window_seconds: int
) -> DataFrame:
    """Events where ``second`` holds and ``first`` held at most the window earlier for
    the same key. Only the latest earlier event matters, so there are no pairs; adds
    ``gap_us``."""
    base = events.select(
        "*",
        micros(F.col("timestamp")).alias("__us"),
        F.coalesce(first, F.lit(False)).alias("__a"),
        F.coalesce(second, F.lit(False)).alias("__b"),
    ).where("__a OR __b")
    seen = running(
        base,
        keys,
        ["__us", "event_id"],
        [Measure("__last", "max", F.when(F.col("__a"), F.col("__us")), inclusive=False)],
    )
    gap = F.col("__us") - F.col("__last")
    return (
        seen.where(F.col("__b") & (gap > 0) & (gap <= window_seconds * US))
        .withColumn("gap_us", gap)
        .drop("__us", "__a", "__b", "__last")
    )
