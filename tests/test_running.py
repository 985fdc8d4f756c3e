"""Ordered operators against brute force, both ways, with hot keys and ties."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palisade.operators.running import (
    GROUP_LIMIT_CONF,
    Distinct,
    Measure,
    Trailing,
    measure_groups,
    rank_by,
    running,
    trailing_distinct,
    trailing_sums,
)


def sample(n=400, seed=1):
    """A third of the rows share one key, a ninth one key and one moment."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else rng.choice("abc")
        us = 50 if i % 9 == 0 else rng.randrange(100)
        out.append((i, key, us, rng.choice([None, 1, 2, 3, 4]), rng.randrange(5)))
    rng.shuffle(out)
    return out


DDL = "id long, k string, us long, v int, x long"


def test_running_matches_brute_force(spark, way):
    data = sample()
    df = spark.createDataFrame(data, DDL).repartition(3)
    got = running(
        df, ["k"], ["us", "id"],
        [
            Measure("total", "sum", F.col("x")),
            Measure("before", "sum", F.col("x"), False),
            Measure("low", "min", F.col("us"), False),
            Measure("prev", "max", F.struct("us", "id"), False),
        ],
    )
    got = {r["id"]: r for r in got.collect()}
    assert len(got) == len(data)
    for i, k, us, _, x in data:
        earlier = sorted((r[2], r[0], r[4]) for r in data if r[1] == k and (r[2], r[0]) < (us, i))
        assert got[i]["total"] == sum(e[2] for e in earlier) + x
        if not earlier:
            assert got[i]["before"] is None and got[i]["low"] is None and got[i]["prev"] is None
        else:
            assert got[i]["before"] == sum(e[2] for e in earlier)
            assert got[i]["low"] == earlier[0][0]
            assert tuple(got[i]["prev"]) == earlier[-1][:2]


def trailing_model(data, window):
    out = {}
    for i, k, us, _, x in data:
        out[i] = sum(
            r[4] for r in data if r[1] == k and us - window < r[2] and (r[2], r[0]) <= (us, i)
        )
    return out


def test_trailing_sums_with_ties(spark, way):
    data = sample()
    df = spark.createDataFrame(data, DDL)
    got = trailing_sums(
        df, ["k"], "us", ["id"],
        [Trailing("n10", F.col("x"), 10), Trailing("n35", F.col("x"), 35)],
    )
    assert got.columns == [*df.columns, "n10", "n35"]
    got = got.collect()
    assert {r["id"]: r["n10"] for r in got} == trailing_model(data, 10)
    assert {r["id"]: r["n35"] for r in got} == trailing_model(data, 35)


def distinct_model(data, window):
    return {
        i: len({
            r[3] for r in data
            if r[1] == k and r[3] is not None and r[2] <= us and (window is None or r[2] > us - window)
        })
        for i, k, us, _, _ in data
    }


def test_trailing_distinct(spark, way):
    data = sample(300, 2)
    df = spark.createDataFrame(data, DDL)
    for window in (1, 7, 30, None):
        got = trailing_distinct(df, ["k"], "us", ["id"], [Distinct("n", "v", window)])
        assert {r["id"]: r["n"] for r in got.collect()} == distinct_model(data, window)
    both = [Distinct("a", "v", 9), Distinct("b", "x", None)]
    got = trailing_distinct(df, ["k"], "us", ["id"], both).collect()
    swapped = [(i, k, us, x, v) for i, k, us, v, x in data]
    assert {r["id"]: r["a"] for r in got} == distinct_model(data, 9)
    assert {r["id"]: r["b"] for r in got} == distinct_model(swapped, None)


def test_rank_without_key(spark, way):
    data = sample(100)
    got = rank_by(spark.createDataFrame(data, DDL), [], ["us", "id"], "n").collect()
    order = sorted((r[2], r[0]) for r in data)
    assert [(r["us"], r["id"]) for r in sorted(got, key=lambda r: r["n"])] == order
    assert sorted(r["n"] for r in got) == list(range(1, 101))


def test_null_keys_are_one_group(spark, way):
    df = spark.createDataFrame([(1, None, 1), (2, None, 2), (3, "a", 3)], "id long, k string, us long")
    got = rank_by(df, ["k"], ["us"], "n").collect()
    assert {r["id"]: r["n"] for r in got} == {1: 1, 2: 2, 3: 1}


def test_empty_input(spark, way):
    df = spark.createDataFrame([], DDL)
    assert running(df, ["k"], ["us"], [Measure("n", "sum", F.col("x"))]).count() == 0
    assert trailing_distinct(df, ["k"], "us", ["id"], [Distinct("n", "v", 5)]).count() == 0


def test_limit_decides_the_way(spark):
    df = spark.createDataFrame(sample(90), DDL)
    try:
        spark.conf.set(GROUP_LIMIT_CONF, "29")
        assert measure_groups(df, ["k"]).hot
        assert measure_groups(df, []).hot
        spark.conf.set(GROUP_LIMIT_CONF, "-1")
        assert not measure_groups(df, []).hot
        spark.conf.set(GROUP_LIMIT_CONF, "90")
        assert not measure_groups(df, ["k"]).hot
    finally:
        spark.conf.unset(GROUP_LIMIT_CONF)


def test_large_groups_are_cut_at_any_partition_count(spark):
    df = spark.range(1_000_000).select("id", (F.col("id") % 4).alias("k"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set(GROUP_LIMIT_CONF, "1000")
        for partitions in ("2", "4", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            cut = measure_groups(df, ["k"])
            assert cut.hot and cut.pieces == 1000
    finally:
        spark.conf.unset(GROUP_LIMIT_CONF)
        spark.conf.set("spark.sql.shuffle.partitions", before)


@settings(max_examples=4, deadline=None)
@given(
    st.lists(
        st.tuples(st.sampled_from("ab"), st.integers(0, 25), st.sampled_from([None, 1, 2]), st.integers(0, 3)),
        min_size=1, max_size=40,
    ),
    st.integers(1, 30),
)
def test_random_rows_and_windows(spark, raw, window):
    data = [(i, *r) for i, r in enumerate(raw)]
    df = spark.createDataFrame(data, DDL)
    try:
        for limit in ("1000000", "0"):
            spark.conf.set(GROUP_LIMIT_CONF, limit)
            got = trailing_sums(df, ["k"], "us", ["id"], [Trailing("n", F.col("x"), window)])
            assert {r["id"]: r["n"] for r in got.collect()} == trailing_model(data, window)
            got = trailing_distinct(df, ["k"], "us", ["id"], [Distinct("n", "v", window)])
            assert {r["id"]: r["n"] for r in got.collect()} == distinct_model(data, window)
    finally:
        spark.conf.unset(GROUP_LIMIT_CONF)


def test_plain_way_has_one_shuffle_and_one_sort(spark):
    df = spark.createDataFrame(sample(50), DDL)
    out = trailing_sums(df, ["k"], "us", ["id"], [Trailing("a", F.col("x"), 5), Trailing("b", F.col("x"), 9)])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("+- Sort [") == 1


def test_what_orders_rows_travels_once(spark, monkeypatch):
    """Keys, time and ties are columns of what is cut; the rest of a row goes along, and no column of it twice."""
    from palisade.operators import running as module

    cuts = []
    monkeypatch.setattr(module, "written", lambda df, name: cuts.append(df.schema) or df.localCheckpoint())
    data = spark.createDataFrame([("a", i, i // 2, i % 3, f"x{i}") for i in range(9)], "k string, id long, us long, v long, rest string")
    cut = module.Cut(True, 2)
    sums = trailing_sums(data, ["k"], "us", ["id"], [Trailing("n", F.lit(1).cast("long"), 2)], cut)
    different = trailing_distinct(data, ["k"], "us", ["id"], [Distinct("d", "v", 2)], cut)
    carried = [s["__row"].dataType.names for s in cuts if "__row" in s.names]
    assert carried == [["v", "rest"], ["v", "rest"]]
    assert sums.columns == [*data.columns, "n"] and different.columns == [*data.columns, "d"]
    assert sorted(sums.drop("n").collect()) == sorted(different.drop("d").collect()) == sorted(data.collect())


def test_more_rows_are_dealt_to_more_tasks(spark, monkeypatch):
    """Whole groups go to as many tasks as their rows ask for, in one shuffle, with the same results."""
    from palisade.operators import running as module

    df = spark.range(0, 3000, 1, 3).select(F.col("id"), (F.col("id") % 97).alias("k"), (F.col("id") * 7).alias("us"))

    def found():
        a = module.running(df, ["k"], ["us", "id"], [module.Measure("s", "sum", F.col("id"))])
        b = module.trailing_sums(df, ["k"], "us", ["id"], [module.Trailing("n", F.lit(1).cast("long"), 5000)])
        return a, b

    want = [sorted(map(tuple, x.collect())) for x in found()]
    monkeypatch.setattr(module, "ROWS_A_TASK", 100)
    for got, rows in zip(found(), want):
        # There are four by default.
        assert got.select(F.spark_partition_id()).distinct().count() > 20
        assert sorted(map(tuple, got.collect())) == rows
