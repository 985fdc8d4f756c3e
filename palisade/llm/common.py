"""Helpers shared by the text operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.session import discard, discard_since, scratch_path, written, written_so_far

__all__ = ["column", "components", "discard", "discard_since", "written_so_far", "let", "release", "scratch_path", "small_batches", "table", "text_batches", "written"]

# Rows of an Arrow batch sent to Python: texts may be long, and a batch is in memory whole.
BATCH_ROWS = "256"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """A top-level column, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def small_batches(spark: SparkSession) -> None:
    """Let few rows at a time travel to Python, since whole texts are in them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of tables nobody holds any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_batches(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable:
    """A ``mapInArrow`` function that applies ``fn`` to each batch that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out

    return run


def components(spark: SparkSession, edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of the links (u, v): rows (node, root), root the least node.

    Alternates two steps until every node links to a root: every node links its larger neighbours
    to its least neighbour, then its smaller ones. Only minima per node are aggregated,
    before the shuffle as well, so a node with any number of links is no bottleneck. Each
    step is written to the shared folder. Links with a null end are ignored; a link of a
    node to itself makes it a component of its own.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def least(e: DataFrame, at: Column) -> DataFrame:
        return written(e.groupBy("u").agg(F.least(F.min("v"), at).alias("m")), f"{name}-least")

    def done(e: DataFrame) -> bool:
        """Whether the links are stars: every node has one link, and none leads to a node that has."""
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionAll(
            e.select(F.col("v").alias("x"), F.lit(0).alias("up"))
        )
        each = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
        return each.where("ups > 1 or (ups = 1 and least = 0)").isEmpty()

    edges = edges.select("u", "v").where("u is not null and v is not null")
    nodes = both(edges).select(F.col("u").alias("node")).distinct()
    now = written(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        f"{name}-links",
    )
    while not done(now):
        pairs = both(now)
        near = least(pairs, F.col("u"))
        large = (
            pairs.join(near, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        large = written(large, f"{name}-large")
        nearest = least(large, F.col("u"))
        stars = large.join(nearest, "u")
        small = (
            stars.where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(stars.select("u", F.col("m").alias("v")))
            .distinct()
        )
        after = written(small, f"{name}-small")
        discard(now, near, large, nearest)
        now = after
    return nodes.join(now, nodes["node"] == now["u"], "left").select(
        "node", F.coalesce(now["v"], nodes["node"]).alias("root")
    )
