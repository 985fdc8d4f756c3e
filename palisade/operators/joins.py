"""Equi-joins that stay even when one key holds a third of the rows, and small in the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of a lookup side that are sent to every task; more are shuffled.
BROADCAST_ROWS = 100_000


def lookup_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join ``big`` to the smaller lookup side.

    No broadcast hint: Spark broadcasts the lookup side when its size is below the session's threshold.
    Otherwise both sides are shuffled, once, and the adaptive planner cuts the
    rows of a hot key over several tasks. Nothing is repeated per task, as that would hide
    the size of the lookup side from the planner.
    """
    return big.join(small, list(on), how)


def join_expanded(rows: DataFrame, listed: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join rows that an ``explode`` made to a table that was written down.

    The planner takes exploded rows to be as small as what they came from and would send them to every
    task, over the driver. So the table is counted: a short one is broadcast, otherwise both
    sides are shuffled.
    """
    short = listed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(listed) if short else listed.hint("merge"), list(on), how)
