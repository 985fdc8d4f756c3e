"""Deterministic identifiers and hash orders."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def alert_id(event_id: Column, name: Column) -> Column:
    """Stable alert key: the same event and rule always give the same id."""
    return F.md5(F.concat(event_id.cast("string"), F.lit(":"), name))


def hash_order(row_id: Column) -> Column:
    """A fixed shuffle order for sampling."""
    return F.md5(row_id.cast("string"))


def hash_percent(row_id: Column) -> Column:
    """A fixed number in 0..99 per row id."""
    head = F.substring(F.md5(row_id.cast("string")), 1, 8)
    return F.pmod(F.conv(head, 16, 10).cast("long"), F.lit(100))
