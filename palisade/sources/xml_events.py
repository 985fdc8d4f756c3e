"""Windows event log exports (XML) to host events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.text import blank_to_null
from palisade.functions.timestamps import parse_timestamp, squeeze
from palisade.sources.common import numbered, to_event_schema, to_process_id

XML_DDL = (
    "System STRUCT<EventID: STRING, TimeCreated: STRUCT<_SystemTime: STRING>, Computer: STRING>,"
    " EventData STRUCT<Data: ARRAY<STRUCT<_Name: STRING, _VALUE: STRING>>>"
)


def read_xml_events(
    spark: SparkSession, path: str, year: Column, now: Column, glob: str | None = None
) -> DataFrame:
    """Every ``Event`` element of the files, with or without a namespace prefix."""
    reader = (
        spark.read.format("xml")
        .schema(XML_DDL)
        .option("rowTag", "Event")
        .option("ignoreNamespace", "true")
        .option("mode", "PERMISSIVE")
    )
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.load(path).select(
        F.col("_metadata.file_name").alias("source"),
        "System",
        "EventData",
    )
    return xml_events(numbered(rows), year, now)


def xml_events(rows: DataFrame, year: Column, now: Column) -> DataFrame:
    """Events from (event_id, source, System, EventData); elements without a System
    part are skipped."""
    named = F.filter(
        F.coalesce(F.col("EventData.Data"), F.array()), lambda d: d["_Name"].isNotNull()
    )

    def value(name: str) -> Column:
        hit = F.try_element_at(F.filter(F.col("named"), lambda d: d["_Name"] == name), F.lit(-1))
        return blank_to_null(F.trim(hit["_VALUE"]))

    keys = F.array_distinct(F.transform("named", lambda d: d["_Name"]))
    fields = F.map_from_arrays(
        keys,
        F.transform(
            keys,
            lambda k: F.element_at(F.filter(F.col("named"), lambda d: d["_Name"] == k), -1)["_VALUE"],
        ),
    )
    raw = F.to_json(
        F.struct(F.col("System.EventID").alias("event_id"), fields.alias("event_data"))
    )
    stamp = F.col("stamp")
    seen = F.when(stamp.isNull(), now).otherwise(parse_timestamp(stamp, year))
    return to_event_schema(
        rows.where("System IS NOT NULL")
        .withColumn("named", named)
        .withColumn("stamp", blank_to_null(squeeze(F.col("System.TimeCreated._SystemTime"))))
        .select(
            "event_id",
            "source",
            seen.alias("timestamp"),
            F.lit("host").alias("event_type"),
            F.col("System.Computer").alias("hostname"),
            value("TargetUserName").alias("username"),
            value("ProcessName").alias("process_name"),
            to_process_id(value("ProcessId")).alias("process_id"),
            value("CommandLine").alias("command_line"),
            value("ParentProcessName").alias("parent_process"),
            raw.alias("raw_data"),
            seen.isNull().alias("parse_error"),
        ),
        "parse_error",
    )
