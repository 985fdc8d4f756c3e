"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_entry(spark):
    assert entry(spark).count() > 0


def test_names():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    ok, line = compare(spark, con, FOLDER, name, queries()[name], oracle_sql().get(name))
    assert ok, line


def test_stored_events_are_dealt_by_their_number(spark, monkeypatch):
    """What one task sorts when events are stored does not grow with them."""
    from contract import adapters

    monkeypatch.setattr(adapters, "ROWS_A_TASK", 100)
    monkeypatch.setattr(adapters, "_STORED", {})
    stored = adapters.all_events(spark, "/root/testdata/sf0.001")
    files = stored.groupBy(F.input_file_name(), "event_type").count().agg(F.max("count"), F.sum("count")).first()
    assert files[0] < 200 and files[1] == 2 * spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
