"""Rules to Columns: one boolean per rule, all evaluated in the same scan."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.rules.model import Condition, Rule

# Tests that are cheap run first in the conjunction.
_COST = {"equals": 0, "in": 0, "range": 0, "contains": 1, "regex": 2}


def field(df: DataFrame, path: str) -> tuple[Column, T.DataType]:
    """A column by name, by struct path, or by path into the raw JSON."""
    head, *rest = path.split(".")
    if head not in df.columns:
        if head not in ("raw_data", "features"):
            return F.lit(None).cast("string"), T.StringType()
        raise ValueError(f"field {path} needs column {head}")
    kind = df.schema[head].dataType
    if not rest:
        return F.col(head), kind
    if isinstance(kind, T.StringType):
        return F.get_json_object(head, "$." + ".".join(rest)), T.StringType()
    for name in rest:
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return F.lit(None).cast("string"), T.StringType()
        kind = kind[name].dataType
    return F.col(path), kind


def _typed(value: object, kind: T.DataType):
    """The value in the field's type, or None if it can never be equal to it."""
    if isinstance(kind, T.NumericType):
        if isinstance(value, bool):
            return None
        try:
            number = float(value)
        except (TypeError, ValueError):
            return None
        return int(number) if number.is_integer() else number
    return str(value)


def condition_column(df: DataFrame, c: Condition) -> Column:
    """Whether the condition holds; a NULL field never matches."""
    col, kind = field(df, c.field)
    if c.op == "equals":
        value = _typed(c.value, kind)
        return F.lit(False) if value is None else col == F.lit(value)
    if c.op == "in":
        values = [v for v in (_typed(x, kind) for x in c.values) if v is not None]
        return col.isin(values) if values else F.lit(False)
    if c.op == "range":
        number = col if isinstance(kind, T.NumericType) else col.try_cast("double")
        tests = [number.isNotNull()]
        if c.min is not None:
            tests.append(number >= F.lit(c.min))
        if c.max is not None:
            tests.append(number <= F.lit(c.max))
        return reduce(lambda a, b: a & b, tests)
    if c.op == "contains":
        return col.cast("string").contains(str(c.value))
    if c.op == "regex":
        return col.cast("string").rlike("(?i)" + c.pattern)
    raise ValueError(f"unknown condition type {c.op!r}")


def rule_column(df: DataFrame, rule: Rule, with_conditions: bool = True) -> Column:
    """Conjunction of event type and all conditions, cheap tests first.

    It may be NULL, which a filter and ``when`` treat as false; a plain conjunction
    is what the reader of a Parquet table can push down.
    """
    tests = [] if rule.event_type is None else [F.col("event_type") == rule.event_type]
    if with_conditions:
        ordered = sorted(rule.conditions, key=lambda c: _COST[c.op])
        tests += [condition_column(df, c) for c in ordered]
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def _shown(values) -> str:
    return "[" + ", ".join(str(v) if not isinstance(v, str) else f"'{v}'" for v in values) + "]"


def explain_condition(c: Condition) -> str:
    """How a matched condition is reported."""
    if c.op == "equals":
        return f"equals {c.value}"
    if c.op == "in":
        return f"in {_shown(c.values)}"
    if c.op == "range":
        return f"in range [{c.min}, {c.max}]"
    if c.op == "contains":
        return f"contains {c.value}"
    return f"matches pattern {c.pattern}"


def details_json(rule: Rule) -> str:
    """The match report of a pattern rule; it does not depend on the event."""
    return json.dumps(
        {c.field: explain_condition(c) for c in rule.conditions}, separators=(",", ":")
    )
