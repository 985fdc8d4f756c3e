"""Registration of queries with their checking SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palisade.session import configure, ship_packages

Query = Callable[[SparkSession, str], DataFrame]

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without SQL only its rows are counted."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            # Stored events and alerts are many times larger in memory than in their files, of which the planner decides
            # what to broadcast.
            spark.conf.set("spark.sql.sources.fileCompressionFactor", "10")
            # For the same reason 64 MB of shuffled rows are a GB where they are sorted.
            spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m")
            ship_packages(spark, os.path.join(ROOT, "palisade"), os.path.join(ROOT, "contract"))
            return fn(spark, sf_dir)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
