"""Ordered aggregates that survive a hot key.

A window partition is one task, so a plain ``partitionBy(key)`` breaks once a
single key holds a large share of the data. Every ordered operator here goes
through :func:`running`, which looks at the largest group first:

* groups are small -> an ordinary window, one shuffle;
* otherwise -> the rows are range-partitioned by (key, order), which cuts a hot
  key anywhere, even inside one timestamp; each piece is aggregated on its own
  and receives the total of the pieces before it.

Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.session import written

GROUP_LIMIT_CONF = "spark.palisade.maxGroupRows"
DEFAULT_GROUP_LIMIT = 2_000_000
# Rows of whole groups that one task should hold.
ROWS_A_TASK = 100_000

_CHUNK = "__chunk"
_FOLD = {"sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Measure:
    """A running aggregate; ``inclusive`` decides whether the row itself counts."""

    name: str
    fold: str
    value: Column
    inclusive: bool = True


def group_limit(df: DataFrame) -> int:
    """Rows one window partition may hold; 0 always cuts, a negative number never
    looks at the groups and never cuts."""
    return int(df.sparkSession.conf.get(GROUP_LIMIT_CONF, str(DEFAULT_GROUP_LIMIT)))


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """(all rows, rows of the largest group); counts are combined before the shuffle."""
    if not keys:
        total = df.count()
        return total, total
    row = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.sum("n").alias("total"), F.max("n").alias("largest"))
        .first()
    )
    return row["total"] or 0, row["largest"] or 0


class Cut(NamedTuple):
    """Whether some group is too large for one task, the pieces to cut, and the tasks that whole groups are dealt to
    (0: as many as any shuffle has)."""

    hot: bool
    pieces: int
    tasks: int = 0


def measure_groups(df: DataFrame, keys: Sequence[str]) -> Cut:
    """Look at the group sizes, one job. An operator over a subset of the rows, or
    over a finer key, may reuse the answer.

    A group is too large when it exceeds the limit, however many tasks there are; then
    there are as many pieces as hold a limit of rows each.
    """
    limit = group_limit(df)
    if limit <= 0:
        return Cut(limit == 0, max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    total, largest = group_sizes(df, keys)
    tasks = -(-total // ROWS_A_TASK)
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Cut(largest > limit, max(2, -(-total // limit)), tasks if tasks > usual else 0)


def _dealt(df: DataFrame, keys: Sequence[str], cut: Cut) -> DataFrame:
    """The rows with whole groups dealt to as many tasks as their number asks for, so that a task's memory does not
    grow with the table; the window above needs no further shuffle."""
    return df.repartition(cut.tasks, *keys) if cut.tasks and keys else df


def _over(measure: Measure, window) -> Column:
    last = Window.currentRow if measure.inclusive else -1
    return _FOLD[measure.fold](measure.value).over(
        window.rowsBetween(Window.unboundedPreceding, last)
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    measures: Sequence[Measure],
    cut: Cut | None = None,
) -> DataFrame:
    """Add running aggregates per key, in ascending ``order``.

    ``order`` must be unique within a key. An exclusive measure is NULL on the
    first row of its key.
    """
    cut = cut or measure_groups(df, keys)
    if not cut.hot:
        window = Window.partitionBy(*keys).orderBy(*order)
        return _dealt(df, keys, cut).select("*", *[_over(m, window).alias(m.name) for m in measures])
    return _running_cut(df, keys, order, measures, cut.pieces)


def _running_cut(df, keys, order, measures, pieces) -> DataFrame:
    # The range bounds come from a sample, so the cut is written down once and
    # both readers below see the same pieces.
    cut = written(
        df.select("*", *[m.value.alias(f"__v{i}") for i, m in enumerate(measures)])
        .repartitionByRange(pieces, *keys, *order)
        .withColumn(_CHUNK, F.spark_partition_id()),
        "cut",
    )
    totals = cut.groupBy(*keys, _CHUNK).agg(
        *[_FOLD[m.fold](f"__v{i}").alias(f"__t{i}") for i, m in enumerate(measures)]
    )
    earlier = (
        Window.partitionBy(*keys)
        .orderBy(_CHUNK)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # Only the first key of a piece can continue from an earlier piece, so this
    # table has fewer rows than there are pieces.
    carried = totals.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col(_CHUNK).alias("__c"),
        F.count(F.lit(1)).over(earlier).alias("__before"),
        *[
            _FOLD[m.fold](f"__t{i}").over(earlier).alias(f"__p{i}")
            for i, m in enumerate(measures)
        ],
    ).where("__before > 0")
    same = F.col(_CHUNK) == F.col("__c")
    for i, key in enumerate(keys):
        same = same & F.col(key).eqNullSafe(F.col(f"__k{i}"))
    window = Window.partitionBy(_CHUNK, *keys).orderBy(*order)
    local = cut.select(
        "*",
        *[
            _over(Measure(m.name, m.fold, F.col(f"__v{i}"), m.inclusive), window).alias(f"__l{i}")
            for i, m in enumerate(measures)
        ],
    )
    merged = local.join(F.broadcast(carried), same, "left")
    return merged.select(
        *[F.col(c) for c in df.columns],
        *[
            _merge(m.fold, F.col(f"__p{i}"), F.col(f"__l{i}")).alias(m.name)
            for i, m in enumerate(measures)
        ],
    )


def _merge(fold: str, before: Column, here: Column) -> Column:
    if fold == "sum":
        both = before + here
    else:
        return (F.least if fold == "min" else F.greatest)(before, here)
    return F.coalesce(both, before, here)


def rank_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """1-based position within the key."""
    return running(df, keys, order, [Measure(name, "sum", F.lit(1).cast("long"))])


@dataclass(frozen=True)
class Trailing:
    """A sum over the rows of the last ``window_us`` microseconds."""

    name: str
    value: Column
    window_us: int


def trailing_sums(
    df: DataFrame,
    keys: Sequence[str],
    time_us: str,
    ties: Sequence[str],
    sums: Sequence[Trailing],
    cut: Cut | None = None,
) -> DataFrame:
    """Sum over (t - W, t] per key; rows of one microsecond count in tie order.

    Computed as "everything up to this row" minus "everything at or before
    t - W". Both are growing frames, so the cost per row is constant; a sliding
    frame would fold the whole frame again for every row.
    """
    cut = cut or measure_groups(df, keys)
    if cut.hot:
        return _trailing_cut(df, keys, time_us, ties, sums, cut)
    rows = (
        Window.partitionBy(*keys)
        .orderBy(time_us, *ties)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    by_time = Window.partitionBy(*keys).orderBy(time_us)

    def gone(item: Trailing) -> Column:
        frame = by_time.rangeBetween(Window.unboundedPreceding, -item.window_us)
        return F.coalesce(F.sum(item.value).over(frame), F.lit(0))

    return _dealt(df, keys, cut).select(
        "*", *[(F.sum(s.value).over(rows) - gone(s)).alias(s.name) for s in sums]
    )


def _trailing_cut(df, keys, time_us, ties, sums, cut) -> DataFrame:
    lengths = sorted({s.window_us for s in sums})
    # One probe per window length asks how much had passed at t - W; it sorts
    # behind every row of that microsecond.
    marks = [F.struct(F.lit(0).alias("kind"), F.col(time_us).alias("at"))] + [
        F.struct(F.lit(i + 1).alias("kind"), (F.col(time_us) - w).alias("at"))
        for i, w in enumerate(lengths)
    ]
    # What orders the rows travels beside the rest of them.
    payload, restored = _payload(df, {time_us: "__us"} | {t: f"__tie{i}" for i, t in enumerate(ties)}, keys)
    spread = df.select(
        *keys,
        F.col(time_us).alias("__us"),
        *[F.col(t).alias(f"__tie{i}") for i, t in enumerate(ties)],
        *[s.value.alias(f"__s{i}") for i, s in enumerate(sums)],
        payload.alias("__row"),
        F.explode(F.array(*marks)).alias("__mark"),
    )
    is_row = F.col("__mark.kind") == 0
    tie_cols = [f"__tie{i}" for i in range(len(ties))]
    spread = spread.select(
        *keys,
        "__us",
        *tie_cols,
        F.col("__mark.at").alias("__at"),
        F.col("__mark.kind").alias("__kind"),
        F.when(is_row, F.col("__row")).alias("__row"),
        *[F.when(is_row, F.col(f"__s{i}")).alias(f"__s{i}") for i in range(len(sums))],
    )
    seen = running(
        spread,
        keys,
        ["__at", "__kind", "__us", *tie_cols],
        [Measure(f"__r{i}", "sum", F.col(f"__s{i}")) for i in range(len(sums))],
        cut,
    )
    pick = {w: i + 1 for i, w in enumerate(lengths)}
    kind = F.col("__kind")
    out = seen.groupBy(*keys, "__us", *tie_cols).agg(
        F.first("__row", ignorenulls=True).alias("__row"),
        *[
            (
                F.max(F.when(kind == 0, F.col(f"__r{i}")))
                - F.coalesce(F.max(F.when(kind == pick[s.window_us], F.col(f"__r{i}"))), F.lit(0))
            ).alias(s.name)
            for i, s in enumerate(sums)
        ],
    )
    return out.select(*restored, *[s.name for s in sums])


def _payload(df: DataFrame, elsewhere: dict[str, str], keys: Sequence[str]) -> tuple[Column, list[Column]]:
    """(what else than ``keys`` and the columns kept ``elsewhere`` a row has, the row's columns from all of these)."""
    names = {k: k for k in keys} | elsewhere
    rest = [c for c in df.columns if c not in names]
    # Never null, as that tells rows from marks.
    row = F.struct(*[F.col(c) for c in rest]) if rest else F.struct(F.lit(True).alias("__is"))
    return row, [F.col(names[c]).alias(c) if c in names else F.col(f"__row.{c}").alias(c) for c in df.columns]


@dataclass(frozen=True)
class Distinct:
    """The number of different non-NULL values of a column over the last ``window_us``
    microseconds (None: ever seen)."""

    name: str
    value: str
    window_us: int | None


def trailing_distinct(
    df: DataFrame,
    keys: Sequence[str],
    time_us: str,
    ties: Sequence[str],
    counts: Sequence[Distinct],
    cut: Cut | None = None,
) -> DataFrame:
    """Add distinct counts per key; rows of one microsecond see each other.

    A value is present from its first sighting until W after the last one with
    no longer gap, so the count at t is the number of presence intervals open at
    t: a running sum of +1 / -1 marks, with no set held anywhere. All counts share
    one order of rows and marks.
    """
    # Every group below is finer than ``keys`` or a small multiple of its size.
    cut = cut or measure_groups(df, keys)
    tie_cols = [f"__tie{i}" for i in range(len(ties))]
    payload, restored = _payload(df, {time_us: "__at"} | dict(zip(ties, tie_cols)), keys)
    both = df.select(
        *keys,
        F.col(time_us).alias("__at"),
        F.lit(1).alias("__kind"),
        *[F.col(t).alias(c) for t, c in zip(ties, tie_cols)],
        *[F.lit(0).cast("long").alias(f"__d{i}") for i in range(len(counts))],
        payload.alias("__row"),
    )
    # Marks sort before the rows of their moment, so rows see all of them.
    for i, c in enumerate(counts):
        marks = _presence_marks(df, keys, c.value, time_us, c.window_us, cut).select(
            *keys, "__at", F.lit(0).alias("__kind"), F.col("__d").alias(f"__d{i}")
        )
        both = both.unionByName(marks, allowMissingColumns=True)
    counted = running(
        both,
        keys,
        ["__at", "__kind", *tie_cols],
        [Measure(c.name, "sum", F.col(f"__d{i}")) for i, c in enumerate(counts)],
        cut,
    )
    return counted.where("__kind = 1").select(*restored, *[c.name for c in counts])


def _presence_marks(df, keys, value, time_us, window_us, cut) -> DataFrame:
    """(keys, __at, __d): +1 where a value appears, -1 where it has been gone for W."""
    seen = df.where(F.col(value).isNotNull()).select(*keys, value, time_us)
    appears = F.lit(1).cast("long").alias("__d")
    vanishes = F.lit(-1).cast("long").alias("__d")
    time = F.col(time_us)
    if window_us is None:
        first = seen.groupBy(*keys, value).agg(F.min(time).alias("__at"))
        return first.select(*keys, "__at", appears)
    if cut.hot:
        # Equal sightings are combined before any shuffle.
        distinct = seen.distinct()
        opened = running(
            distinct, [*keys, value], [time_us], [Measure("__prev", "max", time, False)], cut
        ).where(F.col("__prev").isNull() | (time - F.col("__prev") >= window_us))
        ended = F.when(F.col("__prev").isNotNull(), _mark(F.col("__prev") + window_us, -1))
        inner = opened.select(
            *keys, F.explode(F.array_compact(F.array(_mark(time, 1), ended))).alias("__m")
        )
        last = distinct.groupBy(*keys, value).agg((F.max(time) + window_us).alias("__at"))
        return inner.select(*keys, "__m.*").unionByName(last.select(*keys, "__at", vanishes))
    order = Window.partitionBy(*keys, value).orderBy(time_us)
    gaps = seen.select(
        *keys, time_us, F.lag(time).over(order).alias("__prev"), F.lead(time).over(order).alias("__next")
    )
    starts = F.col("__prev").isNull() | (time - F.col("__prev") >= window_us)
    ends = F.col("__next").isNull() | (F.col("__next") - time >= window_us)
    both = F.array(F.when(starts, _mark(time, 1)), F.when(ends, _mark(time + window_us, -1)))
    return (
        gaps.where(starts | ends)
        .select(*keys, F.explode(F.array_compact(both)).alias("__m"))
        .select(*keys, "__m.*")
    )


def _mark(at: Column, step: int) -> Column:
    return F.struct(at.alias("__at"), F.lit(step).cast("long").alias("__d"))
