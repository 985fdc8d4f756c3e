"""A detection rule as plain data, and rule tables as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from palisade.schemas import SIGNATURE_SCHEMA
from palisade.session import local_rows

RULE_TYPES = ("pattern", "ioc", "threshold", "correlation")


@dataclass(frozen=True)
class Condition:
    """One test on one field: equals, in, range, contains or regex."""

    field: str
    op: str
    value: object = None
    values: tuple = ()
    min: float | None = None
    max: float | None = None
    pattern: str | None = None


@dataclass(frozen=True)
class Rule:
    name: str
    description: str
    rule_type: str
    rule_content: str
    severity: str
    event_type: str | None = None
    conditions: tuple[Condition, ...] = ()
    threshold: int | None = None
    time_window_seconds: int = 60
    grouping_key: str = "src_ip"
    ioc_values: tuple[str, ...] = ()
    confidence: float = 1.0
    category: str | None = None
    tags: tuple[str, ...] = ()
    references: tuple[str, ...] = ()
    attack_tactics: tuple[str, ...] = ()
    attack_techniques: tuple[str, ...] = ()
    enabled: bool = True
    signature_id: int = 0
    # Of correlation rules: the conditions of each step, and those that begin anew.
    steps: tuple[tuple[Condition, ...], ...] = ()
    reset: tuple[Condition, ...] = ()

    @property
    def counts_ports(self) -> bool:
        """Scan rules count distinct destination ports, all others count rows."""
        return "scan" in self.name.lower() and "failed_login" not in self.name.lower()


# Keys of a written rule that are settings, not conditions on event fields.
SETTINGS = ("threshold", "time_window_seconds", "grouping_key", "ioc_values", "steps", "reset")
REQUIRED = ("name", "rule_type", "rule_content", "severity")


def condition_from(field: str, test: object) -> Condition:
    """A condition as written: ``{"type": ..., ...}``, or a plain value to be equal to."""
    if not isinstance(test, dict):
        return Condition(field, "equals", value=test)
    return Condition(
        field,
        test.get("type"),
        test.get("value"),
        tuple(test.get("values", ())),
        test.get("min"),
        test.get("max"),
        test.get("pattern"),
    )


def _conditions_from(written: dict) -> tuple[Condition, ...]:
    return tuple(condition_from(f, t) for f, t in written.items())


def rule_from_dict(written: dict) -> Rule:
    """A rule written as a mapping, its settings and field tests under ``conditions``."""
    missing = [k for k in REQUIRED if k not in written]
    if missing:
        raise ValueError(f"rule lacks {', '.join(missing)}")
    given = written.get("conditions") or {}
    rest = {k: v for k, v in written.items() if k != "conditions"}
    for name in ("tags", "references", "attack_tactics", "attack_techniques"):
        rest[name] = tuple(rest.get(name) or ())
    settings = {k: given[k] for k in SETTINGS if k in given}
    if "ioc_values" in settings:
        settings["ioc_values"] = tuple(settings["ioc_values"])
    if "steps" in settings:
        settings["steps"] = tuple(_conditions_from(step) for step in settings["steps"])
    if "reset" in settings:
        settings["reset"] = _conditions_from(settings["reset"])
    return Rule(
        **{"description": "", **rest, **settings},
        conditions=tuple(condition_from(f, t) for f, t in given.items() if f not in SETTINGS),
    )


def numbered(rules: Iterable[Rule]) -> list[Rule]:
    """Give rules without an id their position."""
    return [
        r if r.signature_id else replace(r, signature_id=i)
        for i, r in enumerate(rules, start=1)
    ]


def _text(value: object) -> str | None:
    return None if value is None else str(value)


def _float(value: float | None) -> float | None:
    return None if value is None else float(value)


def rules_frame(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """The rule table."""

    def rows_of(conditions: Iterable[Condition]) -> list[tuple]:
        return [
            (
                c.field, c.op, _text(c.value), [str(v) for v in c.values],
                _float(c.min), _float(c.max), c.pattern,
            )
            for c in conditions
        ]

    rows = []
    for r in rules:
        conditions = rows_of(r.conditions)
        rows.append(
            (
                r.signature_id, r.name, r.description, r.rule_type, r.rule_content,
                r.event_type, conditions, r.threshold, r.time_window_seconds,
                r.grouping_key, list(r.ioc_values), r.severity, r.enabled, r.confidence,
                r.category, list(r.tags), list(r.references), list(r.attack_tactics),
                list(r.attack_techniques), [rows_of(step) for step in r.steps], rows_of(r.reset),
            )
        )
    return local_rows(spark, rows, SIGNATURE_SCHEMA)


def rules_from_frame(rules: DataFrame) -> list[Rule]:
    """Read a rule table back; condition values take the type of the event field
    they are compared with."""

    def of(rows) -> tuple[Condition, ...]:
        return tuple(
            Condition(
                c["field"], c["op"], c["value"], tuple(c["values"] or ()),
                _number(c["min"]), _number(c["max"]), c["pattern"],
            )
            for c in rows or ()
        )

    out = []
    for row in rules.orderBy("signature_id").toLocalIterator():
        d = row.asDict()
        conditions = of(d.pop("conditions"))
        d["steps"] = tuple(of(step) for step in d.get("steps") or ())
        d["reset"] = of(d.get("reset"))
        for name in ("ioc_values", "tags", "references", "attack_tactics", "attack_techniques"):
            d[name] = tuple(d[name] or ())
        out.append(Rule(conditions=conditions, **d))
    return out


def _number(x: float | None):
    return int(x) if x is not None and float(x).is_integer() else x
