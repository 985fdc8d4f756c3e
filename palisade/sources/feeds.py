"""Threat-indicator feeds (landed files) to sightings for the indicator table."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from palisade.functions.indicators import indicator_type
from palisade.functions.text import blank_to_null, first_filled, strip

log = logging.getLogger(__name__)

SIGHTING_COLUMNS = [
    "ioc_type", "value", "threat_type", "confidence", "severity", "source", "description", "tags",
]


# What every entry of the address blacklist carries, and the
# confidence and defaults of the other formats.
BLACKLIST = {
    "ioc_type": "ip",
    "threat_type": "c2",
    "confidence": 0.8,
    "severity": "high",
    "source": "abuse_ch",
    "description": "SSL Blacklist - C2 server",
}
BLACKLIST_TAGS = ["c2", "ssl", "abuse_ch"]
CSV_CONFIDENCE = 0.7
LINE_CONFIDENCE = 0.6
DEFAULT_THREAT = "unknown"
DEFAULT_SEVERITY = "medium"
CSV_COLUMNS = {"ip": ["ip", "IP"], "domain": ["domain", "Domain"], "hash": ["hash", "Hash"]}


@dataclass(frozen=True)
class Feed:
    """A feed and where its file landed; ``url`` only decides the format."""

    name: str
    url: str
    path: str
    enabled: bool = True

    @property
    def format(self) -> str:
        if "abuse_ch" in self.name.lower():
            return "blacklist"
        return "csv" if "csv" in self.url.lower() else "lines"


def _content(lines: DataFrame) -> DataFrame:
    trimmed = lines.withColumn("line", strip(F.col("line")))
    return trimmed.where((F.col("line") != "") & ~F.col("line").startswith("#"))


def _sightings(rows: DataFrame) -> DataFrame:
    kinds = {"confidence": "double", "tags": "array<string>"}
    return rows.select(
        *[
            (F.col(c) if c in rows.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c)
            for c in SIGHTING_COLUMNS
        ]
    )


def blacklist_feed(lines: DataFrame) -> DataFrame:
    """``time,address,port`` lines."""
    parts = F.split("line", ",")
    return _sightings(
        _content(lines)
        .where(F.size(parts) >= 2)
        .select(
            strip(F.get(parts, F.lit(1))).alias("value"),
            F.array(*[F.lit(t) for t in BLACKLIST_TAGS]).alias("tags"),
            *[F.lit(v).alias(k) for k, v in BLACKLIST.items()],
        )
    )


def csv_feed(rows: DataFrame, source: str) -> DataFrame:
    """A table with a header; the kind of its first known column is the type."""
    for kind, names in CSV_COLUMNS.items():
        present = [n for n in names if n in rows.columns]
        if present:
            value = first_filled(*[F.col(n) for n in present])
            break
    else:
        kind, value = None, F.lit(None).cast("string")

    def given(name: str, default: str) -> Column:
        return F.col(name) if name in rows.columns else F.lit(default)

    return _sightings(
        rows.select(
            F.lit(kind).cast("string").alias("ioc_type"),
            value.alias("value"),
            given("threat_type", DEFAULT_THREAT).alias("threat_type"),
            F.lit(CSV_CONFIDENCE).alias("confidence"),
            given("severity", DEFAULT_SEVERITY).alias("severity"),
            F.lit(source).alias("source"),
            F.array(F.lit(source)).alias("tags"),
        ).where("value IS NOT NULL")
    )


def line_feed(lines: DataFrame, source: str, hash_first: bool = False) -> DataFrame:
    """One indicator per line, typed by its shape; untypable lines are dropped."""
    return _sightings(
        _content(lines)
        .select(
            indicator_type(F.col("line"), hash_first).alias("ioc_type"),
            F.col("line").alias("value"),
            F.lit(LINE_CONFIDENCE).alias("confidence"),
            F.lit(DEFAULT_SEVERITY).alias("severity"),
            F.lit(source).alias("source"),
            F.array(F.lit(source)).alias("tags"),
        )
        .where(blank_to_null(F.col("ioc_type")).isNotNull())
    )


def read_feed(spark: SparkSession, feed: Feed) -> DataFrame:
    """Sightings of one feed."""
    if feed.format == "csv":
        return csv_feed(spark.read.option("header", True).csv(feed.path), feed.name)
    lines = spark.read.text(feed.path).withColumnRenamed("value", "line")
    return blacklist_feed(lines) if feed.format == "blacklist" else line_feed(lines, feed.name)


def read_feeds(spark: SparkSession, feeds: Sequence[Feed]) -> DataFrame:
    """Sightings of all enabled feeds; a feed that can't be read is logged and left out."""
    parts = []
    for feed in feeds:
        if feed.enabled:
            try:
                parts.append(read_feed(spark, feed))
            except PySparkException as error:
                log.error("feed %s failed: %s", feed.name, error)
    return reduce(DataFrame.unionByName, parts) if parts else _sightings(spark.createDataFrame([], "value string"))


def refresh_feeds(
    spark: SparkSession, feeds: Sequence[Feed], path: str, at: Column | None = None
) -> dict[str, int]:
    """Append each enabled feed's sightings to the indicator log at ``path``.

    Returns the indicators taken from each; a feed that failed or was empty counts 0 and
    does not stop the others. Fold the log with
    :func:`palisade.operators.changelog.current_iocs`.
    """
    stamp = F.current_timestamp() if at is None else at
    counts = {feed.name: 0 for feed in feeds if feed.enabled}
    # Later runs are later in the log: the time leads the sequence, the row follows.
    run = spark.range(1).select(F.unix_micros(F.current_timestamp())).first()[0]
    for number, feed in enumerate(f for f in feeds if f.enabled):
        try:
            rows = read_feed(spark, feed).where("ioc_type IS NOT NULL AND value IS NOT NULL")
            seen = Observation(f"feed-{number}")
            log_rows = rows.select(
                F.struct(
                    F.lit(run).alias("run"),
                    F.lit(number).alias("feed"),
                    F.monotonically_increasing_id().alias("row"),
                ).alias("seq"),
                stamp.alias("at"),
                F.lit("seen").alias("op"),
                F.lit(None).cast("boolean").alias("is_active"),
                *rows.columns,
            ).observe(seen, F.count(F.lit(1)).alias("n"))
            log_rows.write.mode("append").parquet(path)
            counts[feed.name] = seen.get["n"]
        except PySparkException as error:
            log.error("feed %s failed: %s", feed.name, error)
    return counts
