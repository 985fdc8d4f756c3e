"""Matching events against pattern, indicator and threshold rules.

Every matcher returns (event_id, timestamp, signature_id, confidence, details).
"""

from __future__ import annotations

import warnings
from collections import defaultdict
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.functions.timestamps import micros
from palisade.operators.running import (
    Distinct,
    Measure,
    Trailing,
    measure_groups,
    running,
    trailing_distinct,
    trailing_sums,
)
from palisade.rules.compile import details_json, field, rule_column
from palisade.rules.correlation import correlation_matches
from palisade.rules.model import RULE_TYPES, Rule
from palisade.session import local_rows

# Generated code has a size limit per method; rules beyond it go to further arrays.
RULES_PER_ARRAY = 100
# Length of the runs of characters on which command lines and indicators are joined.
GRAM = 4
# Values of a rule that are sought in a command line one by one, in the scan; a longer list is joined.
FEW_VALUES = 50
VALUE_SCHEMA = T.StructType(
    [
        T.StructField("signature_id", T.LongType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("value", T.StringType()),
        T.StructField("gram", T.StringType()),
    ]
)
US = 1_000_000


def _hits(flags: list[tuple[Column, Column]]) -> Column:
    """Array of the values whose flag holds."""
    parts = [
        F.array_compact(F.array(*[F.when(flag, value) for flag, value in flags[i : i + RULES_PER_ARRAY]]))
        for i in range(0, len(flags), RULES_PER_ARRAY)
    ]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def _empty(events: DataFrame) -> DataFrame:
    return events.where(F.lit(False)).select(
        "event_id",
        "timestamp",
        F.lit(0).cast("long").alias("signature_id"),
        F.lit(0.0).alias("confidence"),
        F.lit("").alias("details"),
    )


def enabled_of(rules: Sequence[Rule], rule_type: str) -> list[Rule]:
    return [r for r in rules if r.enabled and r.rule_type == rule_type]


def _any(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _matched(df: DataFrame, flags: list[tuple[Column, Column]]) -> DataFrame:
    """(event_id, timestamp, hit) for every flag that holds.

    Rows without any hit leave in a compiled filter; only the few others are
    expanded.
    """
    if not flags:
        return _empty(df)
    names = [f"__hit{i}" for i in range(len(flags))]
    marked = df.select("*", *[test.alias(n) for n, (test, _) in zip(names, flags)]).where(
        _any([F.col(n) for n in names])
    )
    hits = _hits([(F.col(n), value) for n, (_, value) in zip(names, flags)])
    return marked.select("event_id", "timestamp", F.explode(hits).alias("hit")).select(
        "event_id", "timestamp", "hit.*"
    )


def _match(rule: Rule, confidence: Column, details: Column) -> Column:
    return F.struct(
        F.lit(rule.signature_id).cast("long").alias("signature_id"),
        confidence.alias("confidence"),
        details.alias("details"),
    )


def _pattern_flags(events: DataFrame, rules: Sequence[Rule]) -> list[tuple[Column, Column]]:
    return [
        (rule_column(events, r), _match(r, F.lit(float(r.confidence)), F.lit(details_json(r))))
        for r in enabled_of(rules, "pattern")
        if r.conditions
    ]


def pattern_matches(events: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """All pattern rules in one pass; a rule without conditions matches nothing."""
    return _matched(events, _pattern_flags(events, rules))


def _is_joined(rule: Rule, value: str) -> bool:
    return len(rule.ioc_values) > FEW_VALUES and len(value) >= GRAM


def _with_contained(events: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add, for each rule with indicator values, the last listed one in the command line.

    Values of short lists, and those shorter than a gram, are few and sought one by one, which
    moves no rows. For the others the command line is expanded into its runs of ``GRAM`` characters, and those are joined with the
    first run of each value: an equi-join, however long the lists are. Only joined pairs
    are compared in full. Spark broadcasts the values if they are small.
    """
    rules = [r for r in enabled_of(rules, "ioc") if len(r.ioc_values) > FEW_VALUES]
    listed = [
        (r.signature_id, i, v, v[:GRAM])
        for r in rules
        for i, v in enumerate(r.ioc_values)
        if _is_joined(r, v)
    ]
    out = events
    if listed:
        values = local_rows(events.sparkSession, listed, VALUE_SCHEMA)
        command = F.col("command_line")
        runs = F.transform(F.sequence(F.lit(1), F.length(command) - GRAM + 1), lambda i: F.substring(command, i, F.lit(GRAM)))
        found = (
            events.where((F.col("event_type") == "host") & (F.length(command) >= GRAM))
            .select("event_id", "command_line", F.explode(F.array_distinct(runs)).alias("gram"))
            .join(values, "gram")
            .where(F.col("command_line").contains(F.col("value")))
            .groupBy("event_id")
            .agg(
                *[
                    F.max_by(
                        F.struct("position", "value"),
                        F.when(F.col("signature_id") == r.signature_id, F.col("position")),
                    ).alias(_found(r))
                    for r in rules
                ]
            )
        )
        out = events.join(found, "event_id", "left")
    elif rules:
        nothing = F.lit(None).cast("struct<position:int,value:string>")
        out = events.withColumns({_found(r): nothing for r in rules})
    return out


def _found(rule: Rule) -> str:
    return f"__found_{rule.signature_id}"


def _last_found(rule: Rule) -> Column:
    """The listed value that stands last in the list among those in the command line."""
    command = F.col("command_line")
    if len(rule.ioc_values) <= FEW_VALUES:
        found = [F.when((command != "") & command.contains(v), v) for v in reversed(rule.ioc_values)]
        return F.coalesce(*found)
    best = F.col(_found(rule))
    for i, value in enumerate(rule.ioc_values):
        if not _is_joined(rule, value):
            short = F.struct(F.lit(i).alias("position"), F.lit(value).alias("value"))
            best = F.greatest(best, F.when((command != "") & command.contains(value), short))
    return best["value"]


def _ioc_flags(rules: Sequence[Rule]) -> list[tuple[Column, Column]]:
    network, host = F.col("event_type") == "network", F.col("event_type") == "host"
    flags = []
    for r in enabled_of(rules, "ioc"):
        values = list(r.ioc_values)
        if not values:
            continue
        source = network & F.col("src_ip").isin(values)
        target = network & F.col("dst_ip").isin(values)
        process = host & (F.col("process_name") != "") & F.col("process_name").isin(values)
        last = _last_found(r)
        inside = host & last.isNotNull()
        test = source | target | process | inside
        if r.event_type is not None:
            test = (F.col("event_type") == r.event_type) & test
        found = F.struct(
            F.when(source, F.col("src_ip")).alias("src_ip"),
            F.when(target, F.col("dst_ip")).alias("dst_ip"),
            F.when(process, F.col("process_name")).alias("process_name"),
            F.when(inside, last).alias("command_line"),
        )
        flags.append((test, _match(r, F.lit(float(r.confidence)), F.to_json(found))))
    return flags


def ioc_rule_matches(events: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rules that carry their own indicator values.

    Network events compare source and destination address, host events the
    process name and, as substring, the command line (the last value found in
    list order is reported).
    """
    return _matched(_with_contained(events, rules), _ioc_flags(rules))


def stateless_matches(events: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Pattern and indicator rules together, in one scan."""
    flags = _pattern_flags(events, rules) + _ioc_flags(rules)
    return _matched(_with_contained(events, rules), flags)


def threshold_matches(
    events: DataFrame,
    rules: Sequence[Rule],
    ties: Sequence[str] = ("event_id",),
    legacy: bool = False,
) -> DataFrame:
    """Rules that fire on N events (or N distinct ports) per group in a time window.

    All counting rules of one grouping key share one shuffle and one sort.
    ``legacy`` counts every event of the rule's type from the newest backwards,
    ignores the field conditions and never forgets.
    """
    rules = [r for r in enabled_of(rules, "threshold") if r.threshold]
    by_key = defaultdict(list)
    for r in rules:
        by_key[r.grouping_key].append(r)
    parts = []
    for key, members in by_key.items():
        counted = _prepared(events, key, members, ties, legacy).select("__group")
        cut = measure_groups(counted, ["__group"])
        rows = [r for r in members if not r.counts_ports]
        if rows:
            parts.append(_count_rows(events, key, rows, ties, legacy, cut))
        ports = [r for r in members if r.counts_ports]
        if ports:
            parts.append(_count_ports(events, key, ports, ties, legacy, cut))
    return reduce(DataFrame.unionByName, parts) if parts else _empty(events)


def _prepared(events, key, rules, ties, legacy) -> DataFrame:
    """Only the rows some rule counts, and only the columns counting needs.

    Empty grouping values group nothing, and neither does the number 0; the text "0" is
    a value like any other (root's uid in audit logs). The filter comes first and in plain terms,
    so that it reaches the table reader.
    """
    value, kind = field(events, key)
    given = value != 0 if isinstance(kind, T.NumericType) else value.cast("string") != ""
    group = value.cast("string")
    tests = [rule_column(events, r, with_conditions=not legacy) for r in rules]
    extra = [F.col(t) for t in ties if t not in ("event_id", "timestamp")]
    if any(r.counts_ports for r in rules):
        extra.append(F.expr("nullif(dst_port, 0)").alias("__port"))
    return (
        events.where(given)
        .where(_any(tests))
        .select(
            "event_id",
            "timestamp",
            *extra,
            micros(F.col("timestamp")).alias("__us"),
            group.alias("__group"),
            *[F.coalesce(t, F.lit(False)).alias(f"__f{i}") for i, t in enumerate(tests)],
        )
    )


def _count_rows(events, key, rules, ties, legacy, cut) -> DataFrame:
    base = _prepared(events, key, rules, ties, legacy)
    ones = [F.col(f"__f{i}").cast("long") for i in range(len(rules))]
    if legacy:
        back = [f"__back{i}" for i in range(len(ties))]
        base = base.select(
            "*", (-F.col("__us")).alias("__ago"), *[(-F.col(t)).alias(b) for t, b in zip(ties, back)]
        )
        counted = running(
            base,
            ["__group"],
            ["__ago", *back],
            [Measure(f"__n{i}", "sum", one) for i, one in enumerate(ones)],
            cut,
        )
    else:
        counted = trailing_sums(
            base,
            ["__group"],
            "__us",
            list(ties),
            [
                Trailing(f"__n{i}", one, r.time_window_seconds * US)
                for i, (one, r) in enumerate(zip(ones, rules))
            ],
            cut,
        )
    return _fired(counted, key, rules)


def _count_ports(events, key, rules, ties, legacy, cut) -> DataFrame:
    """All port rules of a key; each counts the ports of its own rows."""
    base = _prepared(events, key, rules, ties, legacy)
    base = base.withColumns({f"__ports{i}": F.when(F.col(f"__f{i}"), F.col("__port")) for i in range(len(rules))})
    time = "__us"
    if legacy:
        base = base.withColumn("__ago", -F.col("__us"))
        time = "__ago"
    counts = [
        Distinct(f"__n{i}", f"__ports{i}", None if legacy else r.time_window_seconds * US) for i, r in enumerate(rules)
    ]
    counted = trailing_distinct(base, ["__group"], time, list(ties), counts, cut)
    return _fired(counted, key, rules)


def _fired(counted: DataFrame, key: str, rules: Sequence[Rule]) -> DataFrame:
    """Rows at or above the threshold, with scaled confidence and the report."""
    flags = []
    for i, r in enumerate(rules):
        n = F.col(f"__n{i}")
        confidence = F.least(
            F.lit(1.0), F.lit(float(r.confidence)) * (n / F.lit(float(r.threshold)))
        )
        details = F.to_json(
            F.struct(
                n.alias("count"),
                F.lit(r.threshold).alias("threshold"),
                F.lit(r.time_window_seconds).alias("time_window"),
                F.concat(F.lit(f"{key}="), F.col("__group")).alias("grouping"),
            )
        )
        flags.append((F.col(f"__f{i}") & (n >= r.threshold), _match(r, confidence, details)))
    return _matched(counted, flags)


def match_events(
    events: DataFrame,
    rules: Sequence[Rule],
    ties: Sequence[str] = ("event_id",),
    legacy: bool = False,
) -> DataFrame:
    """Every rule against every event."""
    for r in rules:
        if r.rule_type not in RULE_TYPES:
            warnings.warn(f"rule {r.name!r} has unknown type {r.rule_type!r}", stacklevel=2)
    parts = [stateless_matches(events, rules)]
    if enabled_of(rules, "threshold"):
        parts.append(threshold_matches(events, rules, ties, legacy))
    if any(r.steps for r in enabled_of(rules, "correlation")):
        parts.append(correlation_matches(events, rules, ties))
    return reduce(DataFrame.unionByName, parts)
