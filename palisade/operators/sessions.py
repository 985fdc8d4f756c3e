"""Sessions: events of a key with no longer silence between them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.timestamps import micros
from palisade.operators.running import Measure, measure_groups, running

US = 1_000_000


def sessions(events: DataFrame, keys: Sequence[str], gap_seconds: int, sums: Mapping[str, Column]) -> DataFrame:
    """(keys, start, end, sums) of every session; ``end`` is the last event's time and the gap.

    An event that comes at most the gap after the one before it belongs to its session. The same as
    Spark's session windows, but a key of any size is cut: the time before is a running
    maximum, sessions are numbered by a running sum, and the sums are combined before the shuffle. Events without a time are left out.
    """
    names = [f"__key{i}" for i in range(len(keys))]
    rows = events.where(F.col("timestamp").isNotNull()).select(
        "*", micros(F.col("timestamp")).alias("__us"), *[F.col(k).alias(n) for k, n in zip(keys, names)]
    )
    cut = measure_groups(rows, names)
    order = ["__us", "event_id"]
    rows = running(rows, names, order, [Measure("__last", "max", F.col("__us"), False)], cut)
    apart = F.coalesce((F.col("__us") - F.col("__last") > gap_seconds * US).cast("long"), F.lit(1).cast("long"))
    rows = running(rows, names, order, [Measure("__session", "sum", apart)], cut)
    found = rows.groupBy(*names, "__session").agg(
        F.min("timestamp").alias("start"),
        F.timestamp_micros(F.max("__us") + F.lit(gap_seconds * US)).alias("end"),
        *[value.alias(name) for name, value in sums.items()],
    )
    return found.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "start", "end", *sums)
