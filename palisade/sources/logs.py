"""Host logs to events: JSON lines, syslog, audit records and plain text.

The parsers take (event_id, source, line) and return event columns plus
``parse_error``, which is true when a timestamp was present but unreadable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.text import blank_to_null, first_filled, strip
from palisade.functions.timestamps import parse_timestamp, squeeze
from palisade.sources.common import numbered, read_lines, to_event_schema, to_process_id
from palisade.sources.xml_events import read_xml_events

# Line shapes.
SYSLOG_MARK = "^<[0-9]+>"
SYSLOG_SHAPE = (
    r"^<(\d+)>(\S+\s+\d+\s+\d+:\d+:\d+)\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s+(.+)$"
)
SYSLOG_PARTS = 6
PART_MARK = "\u0001"
AUDIT_PAIR = r'(\w+)=(?:"([^"]*)"|(\S+))'
AUDIT_TIME = "audit[(]([0-9.]+)"

JSON_FIELDS = [
    "timestamp", "@timestamp", "time", "hostname", "host", "computer", "user", "username",
    "process", "ProcessName", "pid", "ProcessId", "command", "CommandLine",
    "parent", "ParentProcessName",
]
_BROKEN = "_broken"


def parse_json_lines(lines: DataFrame, year: Column, now: Column) -> DataFrame:
    """One JSON object per line; blank and broken lines are skipped."""
    ddl = ", ".join(f"`{f}` STRING" for f in [*JSON_FIELDS, _BROKEN])
    parsed = (
        lines.withColumn("line", strip(F.col("line")))
        .where(F.col("line").startswith("{"))
        .withColumn(
            "j", F.from_json("line", ddl, {"columnNameOfCorruptRecord": _BROKEN})
        )
        .where(F.col("j").isNotNull() & F.col(f"j.{_BROKEN}").isNull())
    )

    def pick(*names: str) -> Column:
        return first_filled(*[F.col("j")[n] for n in names])

    when_text = pick("timestamp", "@timestamp", "time")
    pid = pick("pid", "ProcessId")
    return _events(
        parsed.select(
            "event_id",
            "source",
            when_text.alias("when_text"),
            pick("hostname", "host", "computer").alias("hostname"),
            pick("user", "username").alias("username"),
            pick("process", "ProcessName").alias("process_name"),
            to_process_id(pid).alias("process_id"),
            pick("command", "CommandLine").alias("command_line"),
            pick("parent", "ParentProcessName").alias("parent_process"),
            F.col("line").alias("raw_data"),
        ),
        year,
        now,
    )


def log_format(line: Column) -> Column:
    """audit, syslog or generic."""
    audit = line.contains("type=SYSCALL") | line.contains("type=EXECVE")
    return F.when(audit, "audit").when(line.rlike(SYSLOG_MARK), "syslog").otherwise("generic")


def _syslog_parts(line: Column) -> Column:
    """Priority, time, host, process, pid, message; one element if the line differs."""
    marked = F.regexp_replace(
        line, SYSLOG_SHAPE, PART_MARK.join(f"${i}" for i in range(1, SYSLOG_PARTS + 1))
    )
    return F.split(marked, PART_MARK, SYSLOG_PARTS)


def _audit_pairs(line: Column) -> Column:
    shape = F.lit(AUDIT_PAIR)
    quoted = F.regexp_extract_all(line, shape, F.lit(2))
    bare = F.regexp_extract_all(line, shape, F.lit(3))
    keys = F.regexp_extract_all(line, shape, F.lit(1))
    zipped = F.arrays_zip(keys.alias("k"), quoted.alias("q"), bare.alias("b"))
    return F.transform(
        zipped,
        lambda p: F.struct(
            p["k"].alias("k"), F.when(p["q"] != "", p["q"]).otherwise(p["b"]).alias("v")
        ),
    )


def _audit_fields(pairs: Column) -> Column:
    """The pairs as a map, last value per key; keys rarely repeat."""
    keys = F.transform(pairs, lambda p: p["k"])
    distinct = F.array_distinct(keys)
    last = F.transform(
        distinct, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]
    )
    return F.when(F.size(distinct) == F.size(keys), F.map_from_entries(pairs)).otherwise(
        F.map_from_arrays(distinct, last)
    )


def parse_text_lines(lines: DataFrame, year: Column, now: Column) -> DataFrame:
    """Audit, syslog and other lines in one pass; blank lines, comments and
    malformed syslog lines are skipped.

    Each line meets its pattern once: audit lines become an array of pairs, syslog
    lines an array of their parts.
    """
    routed = (
        lines.withColumn("line", strip(F.col("line")))
        .where((F.col("line") != "") & ~F.col("line").startswith("#"))
        .withColumn("fmt", log_format(F.col("line")))
        .withColumn("pairs", F.when(F.col("fmt") == "audit", _audit_pairs(F.col("line"))))
        .withColumn("fields", _audit_fields(F.col("pairs")))
        .withColumn("parts", F.when(F.col("fmt") == "syslog", _syslog_parts(F.col("line"))))
        .where((F.col("fmt") != "syslog") | (F.size("parts") == SYSLOG_PARTS))
    )
    audit, syslog = F.col("fmt") == "audit", F.col("fmt") == "syslog"
    fields, line = F.col("fields"), F.col("line")

    def value(key: str) -> Column:
        return F.try_element_at(fields, F.lit(key))

    def part(i: int) -> Column:
        return blank_to_null(F.get("parts", F.lit(i - 1)))

    audit_raw = F.to_json(
        F.struct(
            *[
                value(key).alias(name)
                for name, key in [
                    ("audit_type", "type"),
                    ("syscall", "syscall"),
                    ("success", "success"),
                    ("exit", "exit"),
                ]
            ],
            fields.alias("all_fields"),
            line.alias("raw_line"),
        )
    )
    syslog_raw = F.to_json(
        F.struct(
            part(1).cast("int").alias("priority"),
            part(6).alias("message"),
            line.alias("raw_line"),
        )
    )
    generic_raw = F.to_json(F.struct(line.alias("message"), line.alias("raw_line")))
    message = value("msg")
    # A message without a number is kept whole, so that it counts as unreadable.
    stamp = F.coalesce(blank_to_null(F.regexp_extract(message, AUDIT_TIME, 1)), message)
    # Fields are NULL unless the line is an audit line, parts unless it is syslog.
    return _events(
        routed.select(
            "event_id",
            "source",
            F.when(audit, stamp).when(syslog, part(2)).alias("when_text"),
            F.coalesce(value("hostname"), part(3)).alias("hostname"),
            value("uid").alias("username"),
            F.coalesce(value("comm"), part(4)).alias("process_name"),
            F.coalesce(value("pid"), part(5)).alias("pid_text"),
            value("a0").alias("command_line"),
            F.when(audit, audit_raw).when(syslog, syslog_raw).otherwise(generic_raw).alias("raw_data"),
        ).withColumn("process_id", to_process_id(F.col("pid_text"))),
        year,
        now,
    )


def _events(rows: DataFrame, year: Column, now: Column) -> DataFrame:
    """Common tail: read the timestamp, mark unreadable ones, fix the layout."""
    seen = parse_timestamp(F.col("when_text"), year)
    return to_event_schema(
        rows.withColumn("when_text", squeeze(F.col("when_text")))
        .withColumn("timestamp", F.when(F.col("when_text").isNull(), now).otherwise(seen))
        .withColumn("event_type", F.lit("host"))
        .withColumn("parse_error", F.col("timestamp").isNull()),
        "parse_error",
    )


def read_json_logs(
    spark: SparkSession, path: str, year: Column, now: Column, glob: str | None = None
) -> DataFrame:
    return parse_json_lines(read_lines(spark, path, glob), year, now)


def read_text_logs(
    spark: SparkSession, path: str, year: Column, now: Column, glob: str | None = None
) -> DataFrame:
    return parse_text_lines(read_lines(spark, path, glob), year, now)


def read_log_directory(
    spark: SparkSession,
    path: str,
    year: Column | None = None,
    now: Column | None = None,
    text_glob: str = "*.log",
) -> DataFrame:
    """All logs of a folder: text, JSON lines and Windows event XML.

    A folder may lack some of the kinds; unreadable lines cost only themselves.
    """
    now = F.current_timestamp() if now is None else now
    year = F.year(now) if year is None else year
    parts = [
        read_text_logs(spark, path, year, now, text_glob),
        read_json_logs(spark, path, year, now, "*.json"),
        read_xml_events(spark, path, year, now, "*.{xml,evtx}"),
    ]
    return numbered(reduce(DataFrame.unionByName, parts))
