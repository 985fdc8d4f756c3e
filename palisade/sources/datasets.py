"""Labelled training sets; each reader returns the features and a ``label`` column."""

from __future__ import annotations

import csv
from collections import Counter
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.anomaly.prep import sample_rows
from palisade.session import written

# Column names of the 43-column headerless set.
KDD_COLUMNS = [
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes", "land",
    "wrong_fragment", "urgent", "hot", "num_failed_logins", "logged_in", "num_compromised",
    "root_shell", "su_attempted", "num_root", "num_file_creations", "num_shells",
    "num_access_files", "num_outbound_cmds", "is_host_login", "is_guest_login", "count",
    "srv_count", "serror_rate", "srv_serror_rate", "rerror_rate", "srv_rerror_rate",
    "same_srv_rate", "diff_srv_rate", "srv_diff_host_rate", "dst_host_count",
    "dst_host_srv_count", "dst_host_same_srv_rate", "dst_host_diff_srv_rate",
    "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate", "dst_host_serror_rate",
    "dst_host_srv_serror_rate", "dst_host_rerror_rate", "dst_host_srv_rerror_rate", "label",
    "difficulty",
]
KDD_TEXT = {"protocol_type", "service", "flag", "label"}
ROW_ID = "row_id"
ENCODING = "ISO-8859-1"
# The sets by name, and what their readers take.
FLOW_SET, HEADERLESS_SET, LABELLED_SET = "CIC-IDS2017", "NSL-KDD", "UNSW-NB15"


def with_row_id(df: DataFrame) -> DataFrame:
    """A row id from the read's partition and position: unique, and the same for a retried task and for another
    run over the same files and split settings."""
    return df.withColumn(ROW_ID, F.monotonically_increasing_id())


def _sampled(df: DataFrame, sample_size: int | None) -> DataFrame:
    return df if not sample_size else sample_rows(df, ROW_ID, sample_size)


def _column_name(header: str) -> str:
    """Trimmed, without dots, which would read as a path into a struct."""
    name = header.strip().replace(".", "_")
    return "label" if name == "Label" else name


def _column_names(cells: Sequence[str]) -> list[str]:
    """The names of a header's columns; a name's second and further columns get a number."""
    out, seen = [], Counter()
    for i, cell in enumerate(cells):
        name = _column_name(cell) or f"_c{i}"
        out.append(f"{name}_{seen[name]}" if seen[name] else name)
        seen[name] += 1
    return out


def _headers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, header): the first line of every file.

    Where it stands is found first, as the least number, so that no lines are put in order; a second pass over the same
    splits takes it.
    """
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
        F.monotonically_increasing_id().alias("place"),
    )
    # One row a file.
    first = written(lines.where("block = 0").groupBy("file").agg(F.min("place").alias("place")), "csv-places")
    found = lines.join(F.broadcast(first.select("place")), "place", "left_semi")
    heads = found.select("file", F.decode(F.col("value").cast("binary"), ENCODING).alias("header"))
    return written(heads, "csv-headers")


def flow_csv_set(spark: SparkSession, paths: Sequence[str], sample_size: int | None = None) -> DataFrame:
    """Header CSVs whose columns may differ from file to file; all values but the
    label become numbers. Without a label column every row is benign.

    All files are one read, so the plan does not grow with them. Their headers are gathered first, one line a file;
    files with the same header are a form, and a column is taken from where its form has it.
    """
    heads = _headers(spark, paths)
    # One row a form: sets have a few.
    forms = [r["header"] for r in heads.select("header").distinct().orderBy("header").collect()]
    cells = [next(csv.reader([line]), []) for line in forms]
    names = [_column_names(c) for c in cells]
    numbered = heads.withColumn("form", F.array_position(F.array(*map(F.lit, forms)), F.col("header")) - 1)
    width = max(map(len, cells), default=1)
    raw = (
        spark.read.schema(", ".join(f"_c{i} STRING" for i in range(width)))
        .option("encoding", ENCODING)
        .csv(list(paths))
        .select("*", F.col("_metadata.file_path").alias("file"))
    )
    rows = with_row_id(raw).join(numbered.select("file", "form"), "file")

    def is_header(form: int) -> Column:
        same = [F.col(f"_c{i}").eqNullSafe(F.lit(c or None)) for i, c in enumerate(cells[form])]
        return reduce(lambda a, b: a & b, same, F.col("form") == form)

    headers = reduce(lambda a, b: a | b, map(is_header, range(len(forms))), F.lit(False))
    every = list(dict.fromkeys(name for some in names for name in some))

    def column(name: str) -> Column:
        places = [(form, some.index(name)) for form, some in enumerate(names) if name in some]
        out = F.lit(None).cast("string")
        for form, place in places:
            out = F.when(F.col("form") == form, F.col(f"_c{place}")).otherwise(out)
        return out

    label = column("label") if "label" in every else F.lit("BENIGN")
    typed = rows.where(~headers).select(
        ROW_ID, *[column(c).try_cast("double").alias(c) for c in every if c != "label"], label.alias("label")
    )
    return _sampled(typed, sample_size)


def kdd_set(spark: SparkSession, path: str, sample_size: int | None = None) -> DataFrame:
    """The headerless set, without its difficulty column."""
    ddl = ", ".join(f"`{c}` {'STRING' if c in KDD_TEXT else 'DOUBLE'}" for c in KDD_COLUMNS)
    raw = with_row_id(spark.read.schema(ddl).csv(path))
    return _sampled(raw.drop("difficulty"), sample_size)


def labelled_csv_set(
    spark: SparkSession, path: str, sample_size: int | None = None
) -> DataFrame:
    """A header CSV with ``label`` 0/1; the attack category and the file's own row
    number are dropped."""
    raw = with_row_id(spark.read.option("header", True).csv(path))
    if "label" not in raw.columns:
        raise ValueError("no label column")
    return _sampled(raw.drop("attack_cat", "id"), sample_size)


def named_set(spark: SparkSession, name: str, path: str, sample_size: int | None = None) -> DataFrame:
    """A set by its published name, its files under ``path``."""
    if name == FLOW_SET:
        return flow_csv_set(spark, [path], sample_size)
    if name == HEADERLESS_SET:
        return kdd_set(spark, path, sample_size)
    if name == LABELLED_SET:
        return labelled_csv_set(spark, path, sample_size)
    raise ValueError(f"unknown data set {name!r}")


def column_kinds(table: DataFrame) -> tuple[list[str], list[str]]:
    """(numbers, texts) among the columns besides the row id and the label: a text column all of whose
    values are numbers is one of numbers. One pass, and none if the types say it."""
    features = [f for f in table.schema if f.name not in (ROW_ID, "label")]
    texts = [f.name for f in features if isinstance(f.dataType, T.StringType)]
    if texts:
        value = lambda c: F.col(f"`{c}`")
        words = table.agg(
            *[F.count_if(value(c).isNotNull() & value(c).try_cast("double").isNull()).alias(f"n{i}") for i, c in enumerate(texts)]
        ).first()
        texts = [c for i, c in enumerate(texts) if words[f"n{i}"]]
    return [f.name for f in features if f.name not in texts], texts
