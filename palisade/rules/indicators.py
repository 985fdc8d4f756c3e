"""Indicator lists of any length, as a table.

Addresses and process names are equal to an indicator or not: an equi-join of (value) with the list. Command lines hold
indicators anywhere. Each indicator is filed under one of its runs of ``GRAM`` characters, the one that the
fewest command lines have, so a prefix that thousands of indicators share (http, www., 10.0) is no hot key. Command
lines are taken apart into their runs, those that an indicator is filed under are joined, and only these pairs are
compared in full. Indicators shorter than a run are joined with runs of their own length.

Nothing passes through the driver, and nothing of the list is in the plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.operators.joins import join_expanded
from palisade.rules.matching import enabled_of
from palisade.rules.model import Rule
from palisade.session import local_rows, written

GRAM = 4
LISTED = "signature_id LONG, position LONG, value STRING"


def indicator_list(spark, rules: Sequence[Rule]) -> DataFrame:
    """(signature_id, position, value) of the indicators that rules carry themselves."""
    rows = [(r.signature_id, i, v) for r in enabled_of(rules, "ioc") for i, v in enumerate(r.ioc_values)]
    return local_rows(spark, rows, spark.createDataFrame([], LISTED).schema)


def _runs(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters of a text; none if it is shorter or null."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (size - 1), F.lit(1)))
    cut = F.array_distinct(F.transform(starts, lambda i: text.substr(i, F.lit(size))))
    return F.when(F.length(text) >= size, cut).otherwise(F.array().cast("array<string>"))


def _in_commands(commands: DataFrame, listed: DataFrame) -> DataFrame:
    """(event_id, signature_id, position, value): the indicators in each command line."""
    value, line = F.col("value"), F.col("command_line")
    filed = listed.where(F.length(value) >= GRAM).select("signature_id", "position", "value", F.explode(_runs(value, GRAM)).alias("run"))
    filed = written(filed, "indicator-runs")
    probes = commands.select("event_id", F.explode(_runs(line, GRAM)).alias("run"))
    known = written(filed.select("run").distinct(), "indicator-known")
    common = join_expanded(probes.groupBy("run").count(), known, ["run"], "left_semi")
    common = written(common, "indicator-counts")
    # A value one of whose runs is in no command line is in none.
    rarest = (
        filed.join(common, "run", "left")
        .groupBy("value")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "run")).alias("best"))
        .where("best.n > 0")
        .select("value", F.col("best.run").alias("run"))
    )
    rarest = written(rarest, "indicator-rarest")
    # Only runs under which a value is filed travel, with the command line; there are far fewer than values.
    used = written(rarest.select("run").distinct(), "indicator-used")
    runs = commands.select("event_id", "command_line", F.explode(_runs(line, GRAM)).alias("run"))
    runs = join_expanded(runs, used, ["run"], "left_semi")
    pairs = join_expanded(runs, rarest, ["run"]).where(F.contains(line, value)).select("event_id", "value")
    few = written(listed.where(F.length("value") < GRAM).select("value").distinct(), "indicator-short")
    short = [
        join_expanded(
            commands.select("event_id", F.explode(_runs(line, size)).alias("value")), few.where(F.length("value") == size), ["value"]
        )
        for size in range(1, GRAM)
    ]
    found = reduce(DataFrame.unionByName, [pairs, *short])
    return join_expanded(found, listed, ["value"]).select("event_id", "signature_id", "position", "value")


def indicator_matches(events: DataFrame, rules: Sequence[Rule], listed: DataFrame | None = None) -> DataFrame:
    """(event_id, timestamp, signature_id, confidence, details) of indicator rules, as ``ioc_rule_matches`` gives them.

    ``listed`` has (signature_id, position, value); without it the rules' own values are taken. Network events
    compare source and destination address, host events the process name and, as substring, the command line, of which the
    value with the largest position is reported (of the same position the larger value). Empty and null values
    match nothing. ``event_id`` tells events apart.
    """
    spark = events.sparkSession
    rules = enabled_of(rules, "ioc")
    listed = indicator_list(spark, rules) if listed is None else listed.select("signature_id", "position", "value")
    listed = written(listed.where("value <> ''"), "indicators")
    network, host = F.col("event_type") == "network", F.col("event_type") == "host"
    named = F.filter(
        F.array(
            *[
                F.struct(F.lit(name).alias("field"), F.when(kind, F.col(name)).alias("value"))
                for kind, name in ((network, "src_ip"), (network, "dst_ip"), (host, "process_name"))
            ]
        ),
        lambda x: x["value"] != "",
    )
    equal = join_expanded(events.select("event_id", F.explode(named).alias("x")).select("event_id", "x.*"), listed, ["value"])
    equal = equal.groupBy("event_id", "signature_id", "field").agg(F.max("value").alias("value"))
    commands = events.where(host & (F.col("command_line") != "")).select("event_id", "command_line")
    inside = (
        _in_commands(commands, listed)
        .groupBy("event_id", "signature_id")
        .agg(F.max(F.struct("position", "value"))["value"].alias("value"))
        .withColumn("field", F.lit("command_line"))
    )
    fields = ("src_ip", "dst_ip", "process_name", "command_line")
    per_event = (
        equal.unionByName(inside)
        .groupBy("event_id", "signature_id")
        .agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])
    )
    about = local_rows(
        spark,
        [(r.signature_id, float(r.confidence), r.event_type) for r in rules],
        spark.createDataFrame([], "signature_id LONG, confidence DOUBLE, rule_type STRING").schema,
    )
    found = per_event.join(about, "signature_id").join(events.select("event_id", "timestamp", "event_type"), "event_id")
    fits = F.col("rule_type").isNull() | (F.col("rule_type") == F.col("event_type"))
    return found.where(fits).select(
        "event_id", "timestamp", "signature_id", "confidence", F.to_json(F.struct(*fields)).alias("details")
    )
