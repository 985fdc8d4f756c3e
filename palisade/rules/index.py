"""Thousands of pattern rules against events, by an inverted index of rules.

A rule can only match an event that has the value its equality test names, or the text its "contains" test
names. Each rule is filed under one such value, the one that the fewest events have; a text is filed
under its runs of ``GRAM`` characters, likewise the rarest. Events are taken apart into the same entries,
(field, value) or (field, run), as far as any rule could be filed under them. An equi-join brings events to the
rules filed there. Most of these pairs fall at once, as each rule is also given the rarest entry of another of its
conditions, which is sought among the event's entries. Only for the others the rule's conditions are tested, as data:
the rule is a row, not a column of the plan. So the plan is the same for ten rules and for a hundred thousand.

Rules without an equality or a text of that length (ranges, patterns) can't be filed. They are
columns of one scan, as :func:`palisade.rules.matching.pattern_matches` does it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.operators.joins import join_expanded
from palisade.rules.compile import _typed, details_json, field
from palisade.rules.matching import enabled_of, pattern_matches
from palisade.rules.model import Condition, Rule
from palisade.session import local_rows, written

GRAM = 4

_TEST = T.StructType(
    [
        T.StructField("field", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("values", T.ArrayType(T.StringType())),
        T.StructField("low", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
    ]
)
_RULES = T.StructType(
    [
        T.StructField("signature_id", T.LongType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("details", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("tests", T.ArrayType(_TEST)),
    ]
)
# A way to file a rule: one of its conditions (``test``), by one of its runs or by its values.
_WAYS = T.StructType(
    [
        T.StructField("signature_id", T.LongType()),
        T.StructField("test", T.IntegerType()),
        T.StructField("way", T.IntegerType()),
        T.StructField("entry", T.StringType()),
    ]
)


def _text(value: object) -> str:
    return ("true" if value else "false") if isinstance(value, bool) else str(value)


def _grams(text: str) -> list[str]:
    return sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})


def _test(events: DataFrame, c: Condition) -> tuple | None:
    """The condition as data; None if it can never hold."""
    if c.op in ("equals", "in"):
        kind = field(events, c.field)[1]
        values = [_typed(v, kind) for v in ((c.value,) if c.op == "equals" else c.values)]
        values = [v for v in values if v is not None]
        # Fractions have several spellings, so they are compared as numbers and filed under nothing.
        op = "number" if any(isinstance(v, float) for v in values) else "in"
        return (c.field, op, [_text(v) for v in values], None, None) if values else None
    if c.op == "range":
        bound = lambda x: None if x is None else float(x)
        return c.field, "range", [], bound(c.min), bound(c.max)
    if c.op == "contains":
        return c.field, "contains", [_text(c.value)], None, None
    if c.op == "regex":
        return c.field, "regex", ["(?i)" + c.pattern], None, None
    raise ValueError(f"unknown condition type {c.op!r}")


def _ways(tests: list[tuple]) -> list[tuple[int, list[str]]]:
    """(number of the test, entries): every matching event has one of the entries, and never two."""
    out = []
    for number, (name, op, values, *_) in enumerate(tests):
        if op == "in":
            out.append((number, [f"{name}={v}" for v in values]))
        elif op == "contains":
            out += [(number, [f"{name}~{g}"]) for g in _grams(values[0])]
    return out


def _as_text(events: DataFrame, name: str) -> Column:
    """A field as the tests spell it: whole numbers without a point."""
    value, kind = field(events, name)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        whole = (value == F.floor(value)) & (F.abs(value) < float(1 << 53))
        return F.when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))
    return value.cast("string")


def _entries(events: DataFrame, equal: list[str], contain: list[str]) -> Column:
    """Under what an event can be found: its values, and the runs of its texts."""
    values = [F.concat(F.lit(f"{name}="), _as_text(events, name)) for name in equal]
    runs = []
    for name in contain:
        text = F.coalesce(_as_text(events, name), F.lit(""))
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (GRAM - 1), F.lit(1)))
        cut = F.transform(starts, lambda i: F.concat(F.lit(f"{name}~"), text.substr(i, F.lit(GRAM))))
        runs.append(F.when(F.length(text) >= GRAM, F.array_distinct(cut)).otherwise(F.array().cast("array<string>")))
    return F.concat(F.array_compact(F.array(*values)) if values else F.array().cast("array<string>"), *runs)


def _holds(test: Column, value: Column) -> Column:
    """Whether the value of the test's field passes; a NULL never does."""
    number = value.try_cast("double")
    first = F.get(test["values"], F.lit(0))
    inside = (F.coalesce(number >= test["low"], F.lit(True))) & F.coalesce(number <= test["high"], F.lit(True))
    result = (
        F.when(test["op"] == "in", F.array_contains(test["values"], value))
        .when(test["op"] == "number", F.exists(test["values"], lambda v: v.try_cast("double") == number))
        .when(test["op"] == "range", number.isNotNull() & inside)
        .when(test["op"] == "contains", value.contains(first))
        .otherwise(F.regexp_like(value, first))
    )
    return F.coalesce(result, F.lit(False))


def indexed_matches(events: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(event_id, timestamp, signature_id, confidence, details) of all pattern rules, as ``pattern_matches`` gives them.

    ``event_id`` tells events apart. Rules of which a test can never hold match nothing.
    """
    spark = events.sparkSession
    rows, ways, scanned, fields = [], [], [], set()
    for r in enabled_of(rules, "pattern"):
        tests = [_test(events, c) for c in r.conditions]
        if not tests or None in tests:
            continue
        lists = _ways(tests)
        if not lists:
            scanned.append(r)
            continue
        rows.append((r.signature_id, float(r.confidence), details_json(r), r.event_type, tests))
        ways += [(r.signature_id, test, way, entry) for way, (test, some) in enumerate(lists) for entry in some]
        fields |= {name for name, *_ in tests}
    rest = pattern_matches(events, scanned)
    if not rows:
        return rest
    table = local_rows(spark, rows, _RULES)
    filing = written(local_rows(spark, ways, _WAYS), "rule-ways")
    equal = sorted({entry.split("=", 1)[0] for *_, entry in ways if "=" in entry and entry.split("=", 1)[0] in fields})
    contain = sorted({name for name in fields if any(entry.startswith(f"{name}~") for *_, entry in ways)})
    named = sorted(fields)
    slim = events.select(
        "event_id", "timestamp", "event_type",
        F.create_map(*[x for name in named for x in (F.lit(name), _as_text(events, name))]).alias("fields"),
        _entries(events, equal, contain).alias("entries"),
    )
    slim = slim.select("*", F.transform("entries", lambda e: F.xxhash64(e)).alias("marks"))
    slim = slim.select("event_id", "timestamp", "event_type", "fields", "marks", F.explode("entries").alias("entry"))

    # How many events have each entry that a rule could be filed under; absent ones match nothing.
    known = filing.select("entry").distinct()
    common = slim.select("entry").groupBy("entry").count().join(known, "entry", "left_semi")
    common = written(common, "rule-entries")
    sizes = written(
        filing.join(common, "entry", "left")
        .groupBy("signature_id", "test", "way")
        .agg(F.coalesce(F.sum("count"), F.lit(0)).alias("events")),
        "rule-sizes",
    )
    best = sizes.groupBy("signature_id").agg(F.min(F.struct("events", "way", "test")).alias("best")).where("best.events > 0")
    best = best.select("signature_id", F.col("best.way").alias("way"), F.col("best.test").alias("first"))
    other = (
        sizes.join(best.select("signature_id", "first"), "signature_id")
        .where("test <> first")
        .groupBy("signature_id")
        .agg(F.min(F.struct("events", "way")).alias("best"))
        .select("signature_id", F.col("best.way").alias("way"))
    )
    also = filing.join(other, ["signature_id", "way"]).select("signature_id", F.xxhash64("entry").alias("also")).distinct()
    filed = filing.join(best, ["signature_id", "way"]).select("signature_id", "entry").distinct()
    filed = written(filed.join(also, "signature_id", "left"), "rule-index")
    # Only entries under which a rule is filed travel, with the event.
    used = written(filed.select("entry").distinct(), "rule-used")
    probes = join_expanded(slim, used, ["entry"], "left_semi")
    likely = F.col("also").isNull() | F.array_contains("marks", F.col("also"))
    pairs = join_expanded(probes, filed, ["entry"]).where(likely).join(table, "signature_id")
    fits = F.col("event_type").eqNullSafe(F.col("rule_type")) | F.col("rule_type").isNull()
    found = (
        pairs.select(
            "event_id", "timestamp", "fields", "tests", "signature_id", "confidence", "details",
            slim["event_type"], table["event_type"].alias("rule_type"),
        )
        .where(fits)
        .where(F.forall("tests", lambda t: _holds(t, F.try_element_at("fields", t["field"]))))
        .select("event_id", "timestamp", "signature_id", "confidence", "details")
    )
    return found.unionByName(rest)
