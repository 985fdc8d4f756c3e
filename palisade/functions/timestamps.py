"""Timestamp parsing for log text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: syslog dates, with the year put in front.
SYSLOG_LAYOUT = "yyyy MMM d HH:mm:ss"


def squeeze(text: Column) -> Column:
    """Trimmed, with runs of blanks as one (syslog pads single-digit days)."""
    return F.trim(F.regexp_replace(text, "[ ]+", " "))


def parse_timestamp(squeezed: Column, year: Column) -> Column:
    """ISO 8601, date and time with or without fraction, syslog date (which
    carries no year, so one is given) or epoch seconds; NULL when none fits.

    Takes squeezed text, best made in an earlier projection, as it is used often."""
    iso = squeezed.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}")
    syslog = squeezed.rlike("^[A-Z][a-z]{2} [0-9]")
    # A JSON number may arrive in exponent form.
    epoch = squeezed.rlike("^[0-9]+([.][0-9]+)?([eE][+]?[0-9]+)?$")
    return (
        F.when(iso, squeezed.try_cast("timestamp"))
        .when(
            syslog,
            F.try_to_timestamp(
                F.concat_ws(" ", year.cast("string"), squeezed), F.lit(SYSLOG_LAYOUT)
            ),
        )
        .when(epoch, epoch_to_timestamp(squeezed))
    )


def epoch_to_timestamp(seconds: Column) -> Column:
    """Epoch seconds as text or number, to the microsecond."""
    return F.timestamp_micros(
        F.round(seconds.try_cast("decimal(20,6)") * 1_000_000).cast("long")
    )


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))
