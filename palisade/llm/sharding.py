"""Contiguous shards of equal byte size.

Rows are laid out by (id, checksum of the text). Their sizes are summed from the start of
the layout, and the running sum is cut at equal targets.

1. The narrow rows (id, size, checksum) are range-partitioned and written once, with the
   number of their partition, so that every later step sees the same cut.
2. Each partition is summed; a running sum over these totals, one row a partition, tells
   what lies before each.
3. Inside a partition an ordinary window continues that sum row by row.

Texts are read once and never shuffled. The range partitioner samples its key, and ties in
(id, checksum) are broken by a row number, so any number of equal rows is spread out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade.llm.common import column, discard, written

SHARDS = 16


def row_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *kept: Column) -> DataFrame:
    """(doc_id, size, text_crc32, kept columns): UTF-8 bytes plus 1, checksum of the bytes; a null text has none."""
    text = F.coalesce(column(text_col), F.lit(""))
    return docs.select(
        column(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *kept,
    )


def contiguous_shards(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (place in the shard, from 0) to
    (doc_id, size, text_crc32) and, if the rows have it, their own number ``tie``.

    A row belongs to the shard in which its first byte falls, so a shard's bytes differ
    from the target by less than the largest row. Null ids come first; equal ids lie by
    checksum; repeated rows each get a slot. Of an empty table nothing comes out. A row
    larger than a target leaves the shards that it spans beyond its own empty.
    """
    key = ["doc_id", "text_crc32", "tie"]
    own = ["tie"] if "tie" in rows.columns else []
    tie = F.col("tie") if own else F.monotonically_increasing_id()
    base = written(rows.select("doc_id", "size", "text_crc32", tie.alias("tie")), "shard-sizes")
    laid = written(base.repartitionByRange(*key).withColumn("part", F.spark_partition_id()), "shard-layout")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        laid.groupBy("part")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        # One row a partition.
        .select(
            "part",
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
            F.sum("bytes").over(Window.partitionBy()).alias("bytes_in_all"),
        )
    )
    inside = Window.partitionBy("part").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        laid.withColumn("bytes_here", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("rows_here", F.count("*").over(inside))
        .join(totals, "part")
        .withColumn("start", F.col("bytes_before") + F.col("bytes_here"))
        .withColumn("place", F.col("rows_before") + F.col("rows_here"))
        .withColumn(
            "shard",
            F.floor(F.col("start").cast("decimal(38,0)") * shards / F.col("bytes_in_all")).cast("int"),
        )
    )
    placed = written(placed.select("doc_id", "size", "text_crc32", *own, "start", "place", "shard"), "shard-places")
    # One row a shard.
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first_place"))
    return placed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("place") - F.col("first_place"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write whole rows under ``path/shard=N``, each into the shard that the layout gives it.

    Rows are numbered in a copy, so that equal rows are told apart. Columns of any name are kept, but for one named ``shard``.
    """
    whole = F.struct(*[column(c) for c in docs.columns if c != "shard"]).alias("doc")
    copy = written(docs.select(whole, F.monotonically_increasing_id().alias("tie")), "shard-documents")
    flat = copy.select(F.col("doc").getField(id_col).alias("id"), F.col("doc").getField(text_col).alias("text"), "tie")
    plan = contiguous_shards(row_sizes(flat, "id", "text", F.col("tie")), shards)
    copy.join(plan.select("tie", "shard"), "tie").select("doc.*", "shard").write.partitionBy("shard").parquet(path)
    discard(copy)


def shard_report(docs: DataFrame) -> DataFrame:
    """The contract's columns for all documents."""
    return contiguous_shards(row_sizes(docs)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("start").alias("byte_start"),
    )
