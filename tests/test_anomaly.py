"""Preparation steps against numpy, and models on separable data."""

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from palisade.anomaly import prep
from palisade.anomaly.evaluate import evaluate
from palisade.anomaly.forest import expected_path, score_forest, train_forest
from palisade.functions.scores import anomaly_severity, fusion_severity, normalise
from palisade.plans.train import (
    MODEL_TYPES,
    detect_anomalies,
    load_active,
    metrics_on_test,
    prepare,
    read_registry,
    score_all,
    score_events,
    train,
    train_and_register,
)


@pytest.fixture(scope="module")
def clusters(spark):
    """900 rows around zero, 100 rows far away, one column constant, one text."""
    rng = np.random.default_rng(5)
    normal = rng.normal(0, 1, (900, 3))
    odd = rng.normal(0, 1, (100, 3)) + np.array([8.0, -9.0, 10.0])
    data = [
        (i, *map(float, r), 1.0, "tcp" if i % 3 else "udp", "BENIGN" if i < 900 else "DoS")
        for i, r in enumerate(np.vstack([normal, odd]))
    ]
    return spark.createDataFrame(data, "id long, a double, b double, c double, k double, p string, label string")


def test_quantiles_match_numpy(spark, way):
    rng = np.random.default_rng(1)
    x = [None if i % 7 == 0 else float(rng.integers(0, 20)) for i in range(101)]
    y = rng.normal(size=101).tolist()
    df = spark.createDataFrame(list(zip(x, y)), "x double, y double")
    for p in (0.0, 0.5, 0.95, 1.0):
        got = {r["column"]: r["value"] for r in prep.quantiles(df, ["x", "y"], p).collect()}
        assert got["x"] == pytest.approx(np.quantile([v for v in x if v is not None], p))
        assert got["y"] == pytest.approx(np.quantile(y, p))


def test_quantile_band_of_many_rows(spark, way):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=15_000), np.full(5_000, 0.25), [np.nan] * 10])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    (band,) = prep._bands(df, ["x"], 0.95)
    assert band[2] > 18_000 and band[1] == 20_000
    for p in (0.05, 0.5, 0.6, 0.95):
        got = prep.quantiles(df, ["x"], p).first()["value"]
        assert got == pytest.approx(np.nanquantile(x, p))
    empty = df.where("false")
    assert prep.quantiles(empty, ["x"], 0.5).count() == 0


def test_sample_bound_is_exact(spark):
    df = spark.range(20_000).withColumnRenamed("id", "n")
    want = df.orderBy(F.md5(F.col("n").cast("string")), "n").limit(300)
    assert rows(prep.sample_rows(df, "n", 300), "n") == rows(want, "n")


def test_fill_values(spark):
    df = spark.createDataFrame(
        [(1.0, "b", None), (2.0, "a", None), (None, "a", None), (9.0, "b", None), (None, None, None)],
        "n double, s string, e string",
    )
    fill = prep.fit_fill(df, ["n"], ["s", "e"])
    assert fill == {"n": 2.0, "s": "a", "e": "unknown"}
    assert prep.apply_fill(df, fill).where("n is null or s is null or e is null").count() == 0


def test_classes(spark, way):
    fitted = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b")], "id long, s string")
    classes = prep.fit_classes(fitted, "s")
    assert rows(classes, "code") == [("a", 0), ("b", 1)]
    new = spark.createDataFrame([(1, "a"), (2, "zz"), (3, None)], "id long, s string")
    assert rows(prep.encode(new, "s", classes, "id", "n").select("id", "n"), "id") == [(1, 0), (2, 2), (3, 2)]
    assert rows(prep.encode(new, "s", None, "id", "n").select("n").distinct()) == [(0,)]


def test_numeric(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), ("Infinity",), ("-Infinity",), (None,)], "s string")
    assert [r[0] for r in df.select(prep.numeric(F.col("s"))).collect()] == [1.5, 0, 0, 0, 0, 0]


def test_sample_is_exact_and_stable(spark, way):
    df = spark.range(500).withColumnRenamed("id", "n")
    one = sorted(r[0] for r in prep.sample_rows(df, "n", 37).select("n").collect())
    two = sorted(r[0] for r in prep.sample_rows(df.repartition(7), "n", 37).select("n").collect())
    assert one == two and len(one) == 37
    assert prep.sample_rows(df, "n", 9999).count() == 500


def test_benign_split(spark, clusters):
    marked = prep.benign_split(clusters.withColumn("y", prep.binary_label(F.col("label"))), "y", "id")
    counts = {(r["y"], r["split"]): r["count"] for r in marked.groupBy("y", "split").count().collect()}
    assert counts[(0, "train")] + counts[(0, "test")] == 900
    assert 600 < counts[(0, "train")] < 800 and counts[(1, "test")] == min(100, counts[(0, "test")])
    assert (1, "train") not in counts


def test_stratified_split(spark, way):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1000)] + [(5000, 2)], "id long, y int")
    got = prep.stratified_split(df, "y", "id").groupBy("y").agg(F.avg((F.col("split") == "test").cast("int")).alias("s"))
    share = {r["y"]: r["s"] for r in got.collect()}
    assert share[0] == pytest.approx(0.2, abs=0.01) and share[1] == pytest.approx(0.2, abs=0.02) and share[2] == 0


def test_scaling(spark, clusters):
    scale = prep.fit_scale(clusters, ["a", "k"])
    out = prep.apply_scale(clusters, scale)
    stats = out.agg(F.avg("a"), F.stddev_pop("a"), F.max("k"), F.min("k")).first()
    assert stats[0] == pytest.approx(0, abs=1e-9) and stats[1] == pytest.approx(1) and (stats[2], stats[3]) == (0, 0)


def test_evaluate_one_class_and_empty(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    got = evaluate(df, "y", "p").first()
    assert (got["accuracy"], got["precision"], got["recall"], got["f1_score"], got["false_positive_rate"]) == (1, 0, 0, 0, 0)
    assert evaluate(df.where("false"), "y", "p").first()["accuracy"] == 0


def test_models_find_the_far_rows(spark, clusters):
    data = prepare(clusters, "label", "id", ["a", "b", "c", "k"], ["p"])
    assert data.features == ["a", "b", "c", "k", "p"]
    models = {}
    for name in MODEL_TYPES:
        models[name] = train(name, data, "id")
        m = metrics_on_test(name, models[name], data).first()
        if name != "autoencoder":
            assert m["recall"] > 0.95, name
        assert m["false_positive_rate"] < 0.25, name
    scored = score_all(models, data.test)
    assert data.train.columns == ["id", "label", "a", "b", "c", "k", "p"]
    means = {r["label"]: r for r in scored.groupBy("label").agg(*[F.avg(t).alias(t) for t in MODEL_TYPES]).collect()}
    assert means[1]["isolation_forest"] > means[0]["isolation_forest"] + 0.1
    assert means[1]["one_class_svm"] > means[0]["one_class_svm"]
    with pytest.raises(ValueError, match="unknown model"):
        train("nothing", data, "id")


def test_reconstruction_flags_what_the_code_loses(spark):
    from palisade.anomaly.reconstruction import score_reconstruction, train_reconstruction

    rng = np.random.default_rng(2)
    base = rng.normal(size=(500, 2)) @ rng.normal(size=(2, 6)) + rng.normal(scale=0.05, size=(500, 6))
    off = rng.normal(scale=3, size=(50, 6))
    data = [(i, int(i >= 500), *map(float, r)) for i, r in enumerate(np.vstack([base, off]))]
    names = [f"f{i}" for i in range(6)]
    df = spark.createDataFrame(data, "id long, y int, " + ", ".join(f"{n} double" for n in names))
    model = train_reconstruction(df.where("y = 0"), names, encoding_dim=2)
    got = evaluate(score_reconstruction(df, model), "y", "is_anomaly").first()
    assert got["recall"] > 0.9 and 0.03 < got["false_positive_rate"] < 0.07


def test_forest_scores_do_not_depend_on_partitions(spark, clusters):
    a = train_forest(clusters, ["a", "b"], "id", n_estimators=10, sample_size=64)
    b = train_forest(clusters.repartition(5), ["a", "b"], "id", n_estimators=10, sample_size=64)
    one = rows(score_forest(clusters.select("id", "a", "b"), a).select("id", "score"), "id")
    two = rows(score_forest(clusters.select("id", "a", "b"), b).select("id", "score"), "id")
    assert one == two
    assert expected_path(1) == 0 and expected_path(2) == 1 and round(expected_path(256), 2) == 10.24


def test_bands(spark):
    df = spark.createDataFrame([(0.2,), (0.3,), (0.5,), (0.6,), (0.7,), (0.75,), (0.9,)], "s double")
    got = df.select(anomaly_severity(F.col("s")), fusion_severity(F.col("s"))).collect()
    assert [r[0] for r in got] == ["low", "low", "low", "medium", "medium", "high", "critical"]
    assert [r[1] for r in got] == [None, "low", "medium", "medium", "high", "high", "critical"]
    n = spark.sql("select normalise_in, t from values (-0.25D, 'isolation_forest'), (0D, 'one_class_svm'), (25D, 'autoencoder'), (1D, 'x') v(normalise_in, t)")
    assert [r[0] for r in n.select(normalise(F.col("normalise_in"), F.col("t"))).collect()] == [0.75, 0.5, 1.0, 0.5]


def test_registry_and_store(spark, clusters, tmp_path):
    folder = str(tmp_path)
    assert load_active(spark, folder) == {}
    data = prepare(clusters, "label", "id", ["a", "b", "c"], ["p"], sample_size=600)
    assert data.train.count() + data.test.count() <= 600
    for name in MODEL_TYPES:
        out = train_and_register(data, "id", name, folder, "clusters")
        assert out["training_samples"] == data.train.count()
    train_and_register(data, "id", "autoencoder", folder, "clusters")
    registry = read_registry(spark, folder)
    assert registry.count() == 4
    models = load_active(spark, folder)
    assert list(models) == list(MODEL_TYPES)
    events = clusters.withColumnRenamed("id", "event_id").drop("label")
    scored = score_events(events, "event_id", models)
    assert scored.count() == 1000
    alerts = detect_anomalies(events, models, F.lit("2024-02-01").cast("timestamp"), threshold=0.38)
    odd = alerts.where("event_id >= 900").count()
    assert odd > 50 and alerts.count() - odd < 30
    one = alerts.first()
    assert one["model_name"] == "isolation_forest, one_class_svm, autoencoder"
    with pytest.raises(ValueError, match="no active model"):
        score_events(events, "event_id", {})


def table_of(spark, matrix):
    names = [f"f{i}" for i in range(matrix.shape[1])]
    data = [(i, *map(float, r)) for i, r in enumerate(matrix)]
    return spark.createDataFrame(data, "id long, " + ", ".join(f"{n} double" for n in names)), names


def test_forest_scores_match_a_walk_by_hand(spark):
    x = np.random.default_rng(7).normal(size=(300, 3))
    df, names = table_of(spark, x)
    forest = train_forest(df, names, "id", n_estimators=8, sample_size=32, contamination=0.1)
    assert forest.nodes["tree"].nunique() == 8
    trees = [t.set_index("node") for _, t in forest.nodes.groupby("tree")]

    def depth(tree, row):
        node = tree.loc[0]
        while node["feature"] >= 0:
            side = "left_node" if row[int(node["feature"])] <= node["cut"] else "right_node"
            node = tree.loc[int(node[side])]
        return node["path"]

    want = [2.0 ** -(np.mean([depth(t, r) for t in trees]) / expected_path(32)) for r in x]
    got = score_forest(df, forest).orderBy("id").collect()
    assert [r["score"] for r in got] == pytest.approx(want)
    assert 0.05 < np.mean([r["is_anomaly"] for r in got]) < 0.12


def test_kernel_decision_matches_numpy(spark):
    from palisade.anomaly.kernel import score_kernel, train_kernel

    x = np.random.default_rng(8).normal(size=(400, 4))
    df, names = table_of(spark, x)
    model = train_kernel(df.repartition(3), names, nu=0.2, n_components=64)
    z = np.sqrt(2 / 64) * np.cos(x @ model.directions + model.shifts)
    want = z @ z.mean(axis=0)
    got = np.array([r["decision"] for r in score_kernel(df, model).orderBy("id").collect()])
    assert got + model.offset == pytest.approx(want)
    assert np.mean(got < 0) == pytest.approx(0.2, abs=0.01)
    # With many components (the error falls with their square root) the feature map
    # gives the kernel itself, with gamma = 1 / number of features.
    wide = train_kernel(df, names, n_components=4096)
    got = np.array([r["decision"] for r in score_kernel(df, wide).orderBy("id").collect()])
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 4).mean(axis=1)
    assert np.abs(got + wide.offset - exact).max() < 0.03


def test_reconstruction_error_matches_numpy(spark):
    from palisade.anomaly.reconstruction import score_reconstruction, train_reconstruction

    x = np.random.default_rng(9).normal(size=(200, 5)) * np.array([1, 2, 3, 4, 5]) + 7
    x[:, 4] += 2 * x[:, 0]
    df, names = table_of(spark, x)
    model = train_reconstruction(df, names, encoding_dim=2)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    top = np.linalg.svd(z, full_matrices=False)[2][:2]
    want = ((z - z @ top.T @ top) ** 2).mean(axis=1)
    got = score_reconstruction(df, model).orderBy("id").collect()
    assert [r["error"] for r in got] == pytest.approx(want)
    assert np.mean([r["is_anomaly"] for r in got]) == pytest.approx(0.05, abs=0.011)


def test_training_on_a_flow_csv_set(spark, tmp_path):
    """From files with awkward column names and gaps to registered models."""
    from palisade.sources.datasets import ROW_ID, flow_csv_set

    rng = np.random.default_rng(11)
    lines = [" Flow Duration, Flow Bytes/s,Fwd Len. Mean,Total, Label"]
    for i in range(400):
        far = i >= 340
        a, b, c = rng.normal(20 if far else 0, 1, 3)
        lines.append(f"{a},{'' if i % 9 == 0 else 'Infinity' if i % 50 == 1 else b},{c},{i % 2},{'DDoS' if far else 'BENIGN'}")
    (tmp_path / "d.csv").write_text("\n".join(lines) + "\n")
    table = flow_csv_set(spark, [str(tmp_path / "d.csv")])
    numbers = [c for c in table.columns if c not in (ROW_ID, "label")]
    assert numbers == ["Flow Duration", "Flow Bytes/s", "Fwd Len_ Mean", "Total"]
    data = prepare(table, "label", ROW_ID, numbers)
    for name in MODEL_TYPES:
        out = train_and_register(data, ROW_ID, name, str(tmp_path / "m"), "flows")
        if name == "isolation_forest":
            assert out["metrics"]["recall"] > 0.9
    assert read_registry(spark, str(tmp_path / "m")).count() == 3


def test_named_sets_and_kinds_of_columns(spark, tmp_path):
    from palisade.plans.train import train_from_set
    from palisade.sources.datasets import column_kinds, named_set

    path = str(tmp_path / "set")
    rows_ = [(i, f"{i % 7}", "tcp" if i % 2 else "udp", None if i % 5 else "4", "DoS", int(i % 10 == 0)) for i in range(300)]
    table = spark.createDataFrame(rows_, "id long, a string, p string, b string, attack_cat string, label int")
    table.repartition(3).write.option("header", True).csv(path)
    read = named_set(spark, "UNSW-NB15", path)
    assert column_kinds(read) == (["a", "b"], ["p"])
    assert read.select("row_id").distinct().count() == 300
    report = train_from_set(spark, "UNSW-NB15", path, "isolation_forest", str(tmp_path / "models"))
    assert 0 < report["training_samples"] < 270
    assert read_registry(spark, str(tmp_path / "models")).first()["training_dataset"] == "UNSW-NB15"
    with pytest.raises(ValueError, match="unknown data set"):
        named_set(spark, "else", path)


def test_broken_models_are_left_out(spark, clusters, tmp_path):
    from palisade.session import delete_path

    folder = str(tmp_path)
    data = prepare(clusters, "label", "id", ["a", "b", "c"], ["p"], sample_size=400)
    paths = {name: train_and_register(data, "id", name, folder, "x")["model_path"] for name in MODEL_TYPES}
    delete_path(spark, paths["one_class_svm"] + "/model")
    (tmp_path / "note.txt").write_text("{")
    models = load_active(spark, folder)
    assert list(models) == ["isolation_forest", "autoencoder"]
    events = clusters.withColumnRenamed("id", "event_id")
    other = prepare(clusters.withColumn("z", F.col("a")), "label", "id", ["z"])
    train_and_register(other, "id", "autoencoder", folder, "x")
    scored = score_events(events, "event_id", load_active(spark, folder))
    assert scored.columns == ["event_id", "isolation_forest", "scores"] and scored.count() == 1000


def test_rows_are_walked_through_full_trees():
    """Trees are laid out in full, so that a level is a few operations, and equal rows are walked once."""
    import pandas as pd

    from palisade.anomaly import forest

    draw = np.random.default_rng(11)
    few = draw.normal(size=(7, 2))
    few[0, 0], few[1, 1] = np.nan, np.inf
    x = few[draw.integers(0, 7, 9000)]
    nodes = [forest._grow(["a", "b"], 1)((t,), pd.DataFrame(draw.normal(size=(20 + t, 2)), columns=["a", "b"]).assign(__rank=range(20 + t))) for t in range(5)]
    model = forest.Forest(["a", "b"], pd.concat(nodes), 20)
    want = np.zeros(len(few))
    for t in nodes:
        levels, feature, cut, path = forest._heap(t)
        assert path.size == 1 << levels and feature.size == path.size - 1
        for i, row in enumerate(few):
            node = t.set_index("node").loc[0]
            while node["feature"] >= 0:
                node = t.set_index("node").loc[int(node["left_node" if row[int(node["feature"])] <= node["cut"] else "right_node"])]
            want[i] += node["path"]
    got = forest._walker(model)(x)
    assert got.shape == (9000,) and np.unique(got).size <= 7
    assert forest._walker(model)(few) == pytest.approx(2.0 ** (-(want / 5) / forest.expected_path(20)))
    assert forest._walker(model)(few[:0]).size == 0
