"""Rules of several steps: events of one group that follow each other within a window.

A rule of N steps is an automaton with a state for each number of steps done. What has to be known about a
state is the latest event at which a chain that got that far began: a later beginning serves every
end that an earlier one does. An event that meets step k takes the best beginning of k - 1 steps
over to k. The transition of a stretch of events is therefore a table of maxima, and tables of stretches
compose associatively. In columns: the best beginning of k steps is a running maximum over the
events that meet step k of what k - 1 steps had before them, one pass a step over the same order. Passes go
through :func:`palisade.operators.running.running`, so a group of any size is cut and its
pieces are put together.

A reset event forgets all chains of its group. Resets are counted, beginnings carry the count, and
as it only grows, the maximum is always of the newest count.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.functions.timestamps import micros
from palisade.operators.running import Measure, measure_groups, running
from palisade.rules.compile import field, rule_column
from palisade.rules.model import Condition, Rule

US = 1_000_000


def _holds(events: DataFrame, rule: Rule, conditions: Sequence[Condition]) -> Column:
    """Whether an event of the rule's type meets all conditions; none are never met."""
    if not conditions:
        return F.lit(False)
    step = Rule(rule.name, "", "pattern", "", rule.severity, rule.event_type, tuple(conditions))
    return F.coalesce(rule_column(events, step), F.lit(False))


def correlation_matches(events: DataFrame, rules: Sequence[Rule], ties: Sequence[str] = ("event_id",)) -> DataFrame:
    """(event_id, timestamp, signature_id, confidence, details) of the events that complete a rule.

    An event completes a rule if it meets the last step, and before it, in order of (time, ``ties``), came
    events that meet the others one after the other, the first at most the window earlier, with no
    reset after the first up to and including the last. The reset conditions hold or fail as a whole, and an event that resets
    may begin a chain itself. One event is one step of a chain at most. Empty group values group nothing. ``details`` tells
    when the latest such chain began.
    """
    rules = [r for r in rules if r.enabled and r.rule_type == "correlation" and len(r.steps) > 1]
    by_key = defaultdict(list)
    for r in rules:
        by_key[r.grouping_key].append(r)
    parts = [_of_key(events, key, members, ties) for key, members in by_key.items()]
    if not parts:
        return events.where(F.lit(False)).select(
            "event_id", "timestamp", F.lit(0).cast("long").alias("signature_id"), F.lit(0.0).alias("confidence"),
            F.lit("").alias("details"),
        )
    return reduce(DataFrame.unionByName, parts)


def _of_key(events: DataFrame, key: str, rules: list[Rule], ties: Sequence[str]) -> DataFrame:
    value, kind = field(events, key)
    given = value != 0 if isinstance(kind, T.NumericType) else value.cast("string") != ""
    flags = {(i, k): _holds(events, r, step) for i, r in enumerate(rules) for k, step in enumerate(r.steps)}
    flags |= {(i, "reset"): _holds(events, r, r.reset) for i, r in enumerate(rules)}
    name = lambda i, k: f"__meets_{i}_{k}"
    rows = (
        events.where(given)
        .where(reduce(lambda a, b: a | b, flags.values()))
        .select(
            "event_id",
            "timestamp",
            *[t for t in ties if t not in ("event_id", "timestamp")],
            micros(F.col("timestamp")).alias("__us"),
            value.cast("string").alias("__group"),
            *[flag.alias(name(*at)) for at, flag in flags.items()],
        )
    )
    order = ["__us", *ties]
    cut = measure_groups(rows, ["__group"])
    resets = [Measure(f"__era_{i}", "sum", F.col(name(i, "reset")).cast("long")) for i in range(len(rules))]
    rows = running(rows, ["__group"], order, resets, cut)
    begun = lambda i, k: f"__begun_{i}_{k}"

    def best(i: int, k: int) -> Column:
        """What an event that meets step k offers: itself, or the best beginning of the step before."""
        era = F.col(f"__era_{i}")
        if k == 0:
            return F.when(F.col(name(i, 0)), F.struct(era.alias("era"), F.col("__us").alias("us")))
        before = F.col(begun(i, k - 1))
        return F.when(F.col(name(i, k)) & (before["era"] == era), before)

    for k in range(max(len(r.steps) for r in rules) - 1):
        measures = [Measure(begun(i, k), "max", best(i, k), False) for i, r in enumerate(rules) if k < len(r.steps) - 1]
        rows = running(rows, ["__group"], order, measures, cut)
    hits = []
    for i, r in enumerate(rules):
        before = F.col(begun(i, len(r.steps) - 2))
        fires = F.col(name(i, len(r.steps) - 1)) & (before["era"] == F.col(f"__era_{i}"))
        fires &= F.col("__us") - before["us"] <= r.time_window_seconds * US
        details = F.to_json(
            F.struct(
                F.lit(len(r.steps)).alias("steps"),
                F.lit(r.time_window_seconds).alias("time_window"),
                F.concat(F.lit(f"{key}="), F.col("__group")).alias("grouping"),
                before["us"].alias("began_us"),
            )
        )
        hit = F.struct(
            F.lit(r.signature_id).cast("long").alias("signature_id"),
            F.lit(float(r.confidence)).alias("confidence"),
            details.alias("details"),
        )
        hits.append(F.when(fires, hit))
    found = rows.select("event_id", "timestamp", F.explode(F.array_compact(F.array(*hits))).alias("hit"))
    return found.select("event_id", "timestamp", "hit.*")
