"""Preparation, scoring and evaluation queries."""

from pyspark.sql import functions as F

from contract.adapters import all_events, created_at, net_events, raw_events
from contract.registry import query, table
from palisade.anomaly.evaluate import evaluate
from palisade.anomaly.forest import score_forest, train_forest
from palisade.anomaly.kernel import score_kernel, train_kernel
from palisade.anomaly.prep import (
    apply_fill,
    apply_scale,
    benign_split,
    binary_label,
    encode,
    fit_classes,
    fit_fill,
    fit_scale,
    modes,
    numeric,
    quantiles,
    stratified_split,
)
from palisade.anomaly.reconstruction import score_reconstruction, train_reconstruction
from palisade.functions.hashing import hash_percent
from palisade.functions.scores import anomaly_severity, forest_anomaly, normalise
from palisade.operators.alerts import anomaly_alerts, mean_score
from palisade.operators.features import stored_features
from palisade.operators.running import rank_by
from palisade.plans.train import (
    MODEL_TYPES,
    detect_anomalies,
    load_active,
    metrics_on_test,
    prepare,
    read_registry,
    score,
    score_and_store,
    score_events,
    train_from_set,
    train,
    train_and_register,
)
from palisade.schemas import ALERT_SCHEMA
from palisade.session import delete_path, scratch_path

HASH_SQL = "('0x' || substr(md5(CAST({0} AS VARCHAR)), 1, 8))::BIGINT % 100"
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _gaps(spark, sf):
    """Line items with missing cells."""
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
        "CASE l_linenumber WHEN 3 THEN NULL WHEN 4 THEN double('NaN') ELSE l_extendedprice END AS l_extendedprice",
        "CASE WHEN l_orderkey % 5 <> 1 THEN l_discount END AS l_discount", "l_tax",
        "CASE WHEN l_linenumber <> 2 THEN l_returnflag END AS l_returnflag", "l_linestatus",
    )


GAPS_SQL = """g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity,
  CASE WHEN l_linenumber NOT IN (3, 4) THEN l_extendedprice END AS l_extendedprice,
  CASE WHEN l_orderkey % 5 <> 1 THEN l_discount END AS l_discount, l_tax,
  CASE WHEN l_linenumber <> 2 THEN l_returnflag END AS l_returnflag, l_linestatus FROM lineitem)"""


def _quantile_sql(p):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(quantile_cont({c}, {p}), 6) AS value FROM g" for c in NUMBERS
    )


@query("impute_stats", f"WITH {GAPS_SQL} {_quantile_sql(0.5)}")
def impute_stats(spark, sf):
    """Exact medians of columns with missing cells."""
    return quantiles(_gaps(spark, sf), NUMBERS, 0.5).select(
        "column", F.round("value", 6).alias("value")
    )


@query("quantile_95", f"WITH {GAPS_SQL} {_quantile_sql(0.95)}")
def quantile_95(spark, sf):
    return quantiles(_gaps(spark, sf), NUMBERS, 0.95).select(
        "column", F.round("value", 6).alias("value")
    )


def _mode_sql(c):
    return (
        f"SELECT '{c}' AS \"column\", {c} AS value FROM (SELECT {c}, count(*) AS n FROM g WHERE {c} IS NOT NULL"
        f" GROUP BY {c} ORDER BY n DESC, {c} LIMIT 1)"
    )


@query(
    "impute_modes",
    f"WITH {GAPS_SQL} SELECT * FROM ({_mode_sql('l_returnflag')}) UNION ALL SELECT * FROM ({_mode_sql('l_linestatus')})",
)
def impute_modes(spark, sf):
    return modes(_gaps(spark, sf), ["l_returnflag", "l_linestatus"])


@query(
    "impute_filled",
    f"""WITH {GAPS_SQL}, m AS (SELECT median(l_extendedprice) AS pe, median(l_discount) AS di FROM g),
    f AS ({_mode_sql('l_returnflag')})
    SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(l_extendedprice, (SELECT pe FROM m)), 4) AS l_extendedprice,
      round(coalesce(l_discount, (SELECT di FROM m)), 4) AS l_discount,
      coalesce(l_returnflag, (SELECT value FROM f)) AS l_returnflag FROM g""",
)
def impute_filled(spark, sf):
    rows = _gaps(spark, sf)
    filled = apply_fill(rows, fit_fill(rows, ["l_extendedprice", "l_discount"], ["l_returnflag"]))
    return filled.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.round("l_extendedprice", 4).alias("l_extendedprice"),
        F.round("l_discount", 4).alias("l_discount"), "l_returnflag",
    )


@query(
    "label_encode",
    f"""WITH p AS (SELECT p_partkey, p_name, {HASH_SQL.format("p_partkey")} < 80 AS train FROM part),
    c AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS code FROM (SELECT DISTINCT p_name FROM p WHERE train))
    SELECT p_partkey, coalesce(code, (SELECT count(*) FROM c)) AS code FROM p LEFT JOIN c USING (p_name)""",
)
def label_encode(spark, sf):
    """Names encoded by the classes of the training part; unseen ones share a code."""
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    classes = fit_classes(parts.where(hash_percent(F.col("p_partkey")) < 80), "p_name")
    return encode(parts, "p_name", classes, "p_partkey", "code").select("p_partkey", "code")


@query(
    "multiclass_labels",
    """WITH c AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM part))
    SELECT p_type, code, count(*) AS n FROM part JOIN c USING (p_type) GROUP BY ALL""",
)
def multiclass_labels(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_type")
    coded = encode(parts, "p_type", fit_classes(parts, "p_type"), "p_partkey", "code")
    return coded.groupBy("p_type", "code").agg(F.count(F.lit(1)).alias("n"))


TEXT_NUMBER = (
    "CASE k % 6 WHEN 0 THEN CAST(k AS STRING) WHEN 1 THEN 'abc' WHEN 2 THEN 'NaN'"
    " WHEN 3 THEN 'Infinity' WHEN 4 THEN NULL ELSE '1.5' END"
)


@query(
    "numeric_coerce",
    """SELECT event_id, CASE k % 6 WHEN 0 THEN CAST(k AS DOUBLE) WHEN 5 THEN CAST(1.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS x
    FROM (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)""",
)
def numeric_coerce(spark, sf):
    """Text that is no finite number becomes 0."""
    rows = raw_events(spark, sf).selectExpr("event_id", f"{TEXT_NUMBER} AS t")
    return rows.select("event_id", numeric(F.col("t")).alias("x"))


@query(
    "standardize",
    "WITH s AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUMBERS)
    + " FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, "
    + ", ".join(f"round(({c} - m_{c}) / s_{c}, 4) + 0 AS {c}" for c in NUMBERS)
    + ", CAST(0 AS DOUBLE) AS constant FROM lineitem, s",
)
def standardize(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", *NUMBERS, F.lit(7.0).alias("constant")
    )
    out = apply_scale(rows, fit_scale(rows, [*NUMBERS, "constant"]))
    return out.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        *[(F.round(c, 4) + 0).alias(c) for c in NUMBERS], "constant",
    )


LABEL_TEXT = (
    "CASE k % 9 WHEN 0 THEN 'BENIGN' WHEN 1 THEN ' normal ' WHEN 2 THEN 'DDoS' WHEN 3 THEN '0' WHEN 4 THEN '0.0'"
    " WHEN 5 THEN 'Normal' WHEN 6 THEN '1' WHEN 7 THEN 'NORMAL' ELSE 'benign' END"
)


@query(
    "binary_labels",
    f"""SELECT t, CASE WHEN k % 9 IN (2, 6, 7) THEN 1 ELSE 0 END AS y, count(*) AS n FROM (
      SELECT k, {LABEL_TEXT.replace("STRING", "VARCHAR")} AS t FROM (
        SELECT CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)) GROUP BY ALL""",
)
def binary_labels(spark, sf):
    rows = raw_events(spark, sf).selectExpr(f"{LABEL_TEXT} AS t")
    out = rows.withColumn("y", binary_label(F.col("t")))
    return out.groupBy("t", "y").agg(F.count(F.lit(1)).alias("n"))


@query(
    "benign_split",
    f"""WITH l AS (SELECT doc_id, toxic, {HASH_SQL.format("doc_id")} >= 80 AS t FROM labels),
    a AS (SELECT doc_id FROM l WHERE toxic = 1 ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id
      LIMIT (SELECT count(*) FROM l WHERE toxic = 0 AND t))
    SELECT doc_id, toxic, CASE WHEN t THEN 'test' ELSE 'train' END AS split FROM l WHERE toxic = 0
    UNION ALL SELECT doc_id, 1, 'test' FROM a""",
)
def benign_split_query(spark, sf):
    rows = table(spark, sf, "labels").select("doc_id", "toxic")
    return benign_split(rows, "toxic", "doc_id").select("doc_id", "toxic", "split")


@query(
    "stratified_split",
    """SELECT doc_id, toxic, CASE WHEN percent_rank() OVER (PARTITION BY toxic
      ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) >= 0.8 THEN 'test' ELSE 'train' END AS split FROM labels""",
)
def stratified_split_query(spark, sf):
    rows = table(spark, sf, "labels").select("doc_id", "toxic")
    return stratified_split(rows, "toxic", "doc_id").select("doc_id", "toxic", "split")


@query(
    "confusion_metrics",
    """WITH c AS (SELECT count(*) FILTER (toxic = 1 AND quality = 0) AS tp, count(*) FILTER (toxic = 0 AND quality = 1) AS tn,
      count(*) FILTER (toxic = 0 AND quality = 0) AS fp, count(*) FILTER (toxic = 1 AND quality = 1) AS fn FROM labels)
    SELECT tp AS true_positives, tn AS true_negatives, fp AS false_positives, fn AS false_negatives,
      round(coalesce((tp + tn) / (tp + tn + fp + fn), 0), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
      round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1_score,
      round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS false_positive_rate FROM c""",
)
def confusion_metrics(spark, sf):
    """Low quality taken as a prediction of toxicity."""
    rows = table(spark, sf, "labels").withColumn("predicted", 1 - F.col("quality"))
    out = evaluate(rows, "toxic", "predicted")
    rates = ["accuracy", "precision", "recall", "f1_score", "false_positive_rate"]
    return out.select(
        *[F.round(c, 6).alias(c) if c in rates else F.col(c) for c in out.columns]
    )


MODEL_OF = "CASE k % 4 WHEN 0 THEN 'isolation_forest' WHEN 1 THEN 'one_class_svm' WHEN 2 THEN 'autoencoder' ELSE 'other' END"
RAW_SCORE = "CASE k % 4 WHEN 0 THEN -value / 500 WHEN 1 THEN value / 100 - 2 ELSE value / 20 END"
SCORED_SQL = f"""r AS (SELECT event_id, {MODEL_OF} AS model_type, {RAW_SCORE} AS raw, value, k FROM (
  SELECT event_id, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events))"""


@query(
    "score_normalize",
    f"""WITH {SCORED_SQL} SELECT event_id, model_type,
      round(CASE model_type WHEN 'isolation_forest' THEN greatest(0.0, least(1.0, 1.0 + raw))
        WHEN 'one_class_svm' THEN 1.0 / (1.0 + exp(raw)) WHEN 'autoencoder' THEN greatest(0.0, least(1.0, raw / 10.0))
        ELSE 0.5 END, 6) AS published, round(greatest(0.0, least(1.0, -raw)), 6) AS turned FROM r""",
)
def score_normalize(spark, sf):
    """Published scaling, and the forest score turned the right way round."""
    rows = raw_events(spark, sf).selectExpr("event_id", f"{MODEL_OF} AS model_type", f"{RAW_SCORE} AS raw")
    return rows.select(
        "event_id", "model_type",
        F.round(normalise(F.col("raw"), F.col("model_type")), 6).alias("published"),
        F.round(forest_anomaly(F.col("raw")), 6).alias("turned"),
    )


SCORES = {
    "isolation_forest": "value / 500",
    "one_class_svm": "CASE WHEN k % 3 <> 0 THEN k / 100.0D END",
    "autoencoder": "CASE WHEN k % 7 = 1 THEN 1.0D END",
}
MEAN_SQL = """s AS (SELECT event_id, value / 500 AS a, CASE WHEN k % 3 <> 0 THEN k / CAST(100 AS DOUBLE) END AS b,
  CASE WHEN k % 7 = 1 THEN CAST(1 AS DOUBLE) END AS c FROM r),
m AS (SELECT *, (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / (CASE WHEN a IS NULL THEN 0 ELSE 1 END
  + CASE WHEN b IS NULL THEN 0 ELSE 1 END + CASE WHEN c IS NULL THEN 0 ELSE 1 END) AS mean FROM s)"""


def _score_map(spark, sf):
    rows = raw_events(spark, sf)
    pairs = [x for n, e in SCORES.items() for x in (F.lit(n), F.expr(e).cast("double"))]
    return rows.withColumn("scores", F.create_map(*pairs))


BAND_SQL = "CASE WHEN mean >= 0.9 THEN 'critical' WHEN mean >= 0.75 THEN 'high' WHEN mean >= 0.6 THEN 'medium' ELSE 'low' END"


@query(
    "ensemble_severity",
    f"WITH {SCORED_SQL}, {MEAN_SQL} SELECT event_id, round(mean, 6) AS mean, mean > 0.5 AS is_anomaly, {BAND_SQL} AS severity FROM m",
)
def ensemble_severity(spark, sf):
    mean = mean_score(F.map_filter("scores", lambda _, v: v.isNotNull()))
    rows = _score_map(spark, sf).select("event_id", mean.alias("mean"))
    return rows.select(
        "event_id", F.round("mean", 6).alias("mean"), (F.col("mean") > 0.5).alias("is_anomaly"),
        anomaly_severity(F.col("mean")).alias("severity"),
    )


@query(
    "anomaly_alerts",
    f"""WITH {SCORED_SQL}, {MEAN_SQL}, n AS (SELECT *, 'isolation_forest' || CASE WHEN b IS NULL THEN '' ELSE ', one_class_svm' END
      || CASE WHEN c IS NULL THEN '' ELSE ', autoencoder' END AS model_name FROM m WHERE mean > 0.5)
    SELECT md5(event_id || ':' || model_name) AS alert_id, event_id, 'ML Anomaly Detected' AS title, {BAND_SQL} AS severity,
      'anomaly' AS detection_type, round(mean, 6) AS anomaly_score, model_name FROM n""",
)
def anomaly_alerts_query(spark, sf):
    out = anomaly_alerts(_score_map(spark, sf), F.col("scores"), created_at())
    return out.select(
        "alert_id", "event_id", "title", "severity", "detection_type",
        F.round("anomaly_score", 6).alias("anomaly_score"), "model_name",
    )


EMBEDDED = [f"e{i}" for i in range(64)]


def vectors(spark, sf):
    """Embeddings as 64 numbers; labels 8 and 9 count as attacks."""
    return table(spark, sf, "embeddings").select(
        "vec_id", (F.col("label") >= 8).cast("int").alias("label"),
        *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(EMBEDDED)],
    )


def planted(spark, sf):
    """Embeddings, and a twentieth of them again, moved far away: those are the anomalies.

    Models learn from the first (label 0) and must find the second (label 1).
    """
    rows = vectors(spark, sf).withColumn("label", F.lit(0))
    far = rows.where("vec_id % 20 = 0").select(
        (-F.col("vec_id") - 1).alias("vec_id"), F.lit(1).alias("label"), *[(F.col(c) * -3 + 0.5).alias(c) for c in EMBEDDED]
    )
    return rows.unionByName(far)


PLANTED_SQL = "SELECT count(*) AS n_rows, count(*) FILTER (vec_id % 20 = 0) AS n_planted"


def properties(scored, score, flag, unit_range):
    """What must hold for scores, larger for anomalies, of :func:`planted` rows."""
    ranked = rank_by(scored, [], [score, "vec_id"], "rank")
    ones, zeros = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    area = (F.sum(F.when(F.col("label") == 1, F.col("rank"))) - ones * (ones + 1) / 2) / (ones * zeros)
    inside = F.col(score).isNotNull() & ~F.isnan(score)
    if unit_range:
        inside &= F.col(score).between(0, 1)
    flagged = F.count_if((F.col("label") == 0) & flag) / zeros
    return ranked.agg(
        zeros.alias("n_rows"),
        ones.alias("n_planted"),
        F.bool_and(inside).alias("scores_in_range"),
        flagged.alias("flagged"),
        (area >= 0.95).alias("finds_planted"),
    )


def _flagged_within(table, share, spread):
    return table.withColumn(
        "share_flagged_as_set", F.abs(F.col("flagged") - share) <= spread
    ).drop("flagged")


FOUND_SQL = "TRUE AS scores_in_range, TRUE AS share_flagged_as_set, TRUE AS finds_planted FROM embeddings"


@query("iforest_scores", f"{PLANTED_SQL}, {FOUND_SQL}")
def iforest_scores(spark, sf):
    """Scores on [0, 1]; a tenth of the training rows is flagged; planted rows score higher."""
    rows = planted(spark, sf)
    forest = train_forest(rows.where("label = 0"), EMBEDDED, "vec_id")
    scored = score_forest(rows, forest)
    return _flagged_within(properties(scored, "score", F.col("is_anomaly") == 1, True), 0.1, 0.02)


@query("kernel_oneclass_scores", f"{PLANTED_SQL}, {FOUND_SQL}")
def kernel_oneclass_scores(spark, sf):
    """Negative decisions are anomalies; a tenth of the training rows has one."""
    rows = planted(spark, sf)
    model = train_kernel(rows.where("label = 0"), EMBEDDED)
    scored = score_kernel(rows, model).withColumn("score", -F.col("decision"))
    return _flagged_within(properties(scored, "score", F.col("decision") < 0, False), 0.1, 0.02)


@query("recon_error_scores", f"{PLANTED_SQL}, {FOUND_SQL}")
def recon_error_scores(spark, sf):
    """Errors above the 95th percentile of the training rows are anomalies."""
    rows = planted(spark, sf)
    model = train_reconstruction(rows.where("label = 0"), EMBEDDED)
    scored = score_reconstruction(rows, model)
    return _flagged_within(properties(scored, "error", F.col("is_anomaly") == 1, False), 0.05, 0.02)


def labelled_documents(spark, sf):
    """Labelled documents as a small training set with numbers and texts."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return docs.select(
        "doc_id", "n_chars", F.size(F.split("text", " ")).alias("n_words"),
        F.length(F.regexp_replace("text", "[^0-9]", "")).alias("n_digits"), "quality", "lang",
        "source", "toxic",
    )


@query(
    "prepared_features",
    f"""WITH d AS (SELECT doc_id, toxic, CAST(n_chars AS DOUBLE) AS n_chars, lang, {HASH_SQL.format("doc_id")} >= 80 AS t
      FROM documents JOIN labels USING (doc_id)),
    tr AS (SELECT * FROM d WHERE toxic = 0 AND NOT t),
    c AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS code FROM (SELECT DISTINCT lang FROM tr)),
    e AS (SELECT d.*, CAST(coalesce(code, (SELECT count(*) FROM c)) AS DOUBLE) AS code FROM d LEFT JOIN c ON d.lang = c.lang),
    s AS (SELECT avg(n_chars) AS m1, stddev_pop(n_chars) AS s1, avg(code) AS m2, stddev_pop(code) AS s2
      FROM e WHERE toxic = 0 AND NOT t)
    SELECT doc_id, CASE WHEN toxic = 0 AND NOT t THEN 'train' ELSE 'test' END AS split,
      round((n_chars - m1) / s1, 4) + 0 AS n_chars, round((code - m2) / s2, 4) + 0 AS lang FROM e, s
    WHERE toxic = 0 OR doc_id IN (SELECT doc_id FROM d WHERE toxic = 1 ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id
      LIMIT (SELECT count(*) FROM d WHERE toxic = 0 AND t))""",
)
def prepared_features(spark, sf):
    """Training and test rows after filling, encoding and scaling."""
    data = prepare(labelled_documents(spark, sf), "toxic", "doc_id", ["n_chars"], ["lang"])
    train_rows, test_rows = (
        rows.withColumn("split", F.lit(name)) for name, rows in (("train", data.train), ("test", data.test))
    )
    return train_rows.unionByName(test_rows).select(
        "doc_id",
        "split",
        (F.round("n_chars", 4) + 0).alias("n_chars"),
        (F.round("lang", 4) + 0).alias("lang"),
    )


@query(
    "training_report",
    f"""WITH l AS (SELECT toxic, {HASH_SQL.format("doc_id")} >= 80 AS t FROM documents JOIN labels USING (doc_id)),
    n AS (SELECT count(*) FILTER (toxic = 0 AND t) AS benign, count(*) FILTER (toxic = 1) AS attacks FROM l)
    SELECT unnest(['autoencoder', 'isolation_forest', 'one_class_svm']) AS model_type, least(benign, attacks) AS n_attacks,
      benign AS n_benign, TRUE AS rates_fit_counts FROM n""",
)
def training_report(spark, sf):
    """All model types trained on labelled documents, with their test metrics: they cover
    all test rows, and the rates follow from the counts."""
    data = prepare(
        labelled_documents(spark, sf), "toxic", "doc_id",
        ["n_chars", "n_words", "n_digits", "quality"], ["lang", "source"],
    )
    parts = [
        metrics_on_test(t, train(t, data, "doc_id"), data).withColumn("model_type", F.lit(t))
        for t in MODEL_TYPES
    ]
    tp, tn, fp, fn = (F.col(c) for c in ("true_positives", "true_negatives", "false_positives", "false_negatives"))

    def same(name, top, bottom):
        return F.abs(F.col(name) - F.coalesce(F.try_divide(top, bottom), F.lit(0.0))) < 1e-9

    fit = same("accuracy", tp + tn, tp + tn + fp + fn) & same("precision", tp, tp + fp)
    fit &= same("recall", tp, tp + fn) & same("f1_score", 2 * tp, 2 * tp + fp + fn)
    fit &= same("false_positive_rate", fp, fp + tn)
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select(
        "model_type", (tp + fn).alias("n_attacks"), (tn + fp).alias("n_benign"), fit.alias("rates_fit_counts")
    )


FLOW_FEATURES = [
    "bytes_sent", "bytes_received", "packets_sent", "packets_received", "total_bytes",
    "total_packets", "avg_packet_size", "protocol_tcp", "protocol_udp", "protocol_icmp",
    "src_port", "dst_port", "well_known_port_dst", "ephemeral_port_dst", "service_ssh",
    "service_rdp", "service_smb", "is_private_src", "is_private_dst", "flow_duration",
    "packets_per_second", "bytes_per_second",
]


@query(
    "event_anomaly_alerts",
    """SELECT count(*) AS n_scored, TRUE AS above_threshold_alerted, TRUE AS ids_fit, TRUE AS severities_fit,
    'isolation_forest, one_class_svm, autoencoder' AS model_name FROM events""",
)
def event_anomaly_alerts(spark, sf):
    """Network events to features, three registered models, one mean score, alerts: as many
    as scores lie above the threshold, each with the id and the severity that follow from it."""
    features = stored_features(net_events(spark, sf)).withColumn("label", F.lit(0))
    folder = scratch_path(spark, "models")
    data = prepare(features, "label", "event_id", FLOW_FEATURES)
    for model_type in MODEL_TYPES:
        train_and_register(data, "event_id", model_type, folder, "events")
    models = load_active(spark, folder)
    scored = score_events(features, "event_id", models).select("event_id", mean_score(F.col("scores")).alias("mean"))
    alerts = detect_anomalies(features, models, created_at(), threshold=0.35)
    both = scored.join(alerts, "event_id", "left")
    fired, score = F.col("alert_id").isNotNull(), F.col("anomaly_score")
    band = F.when(score >= 0.9, "critical").when(score >= 0.75, "high").when(score >= 0.6, "medium").otherwise("low")
    wanted_id = F.md5(F.concat(F.col("event_id").cast("string"), F.lit(":"), F.col("model_name")))
    return both.agg(
        F.count(F.lit(1)).alias("n_scored"),
        F.bool_and((F.col("mean") > 0.35) == fired).alias("above_threshold_alerted"),
        F.bool_and(F.when(fired, F.col("alert_id") == wanted_id)).alias("ids_fit"),
        F.bool_and(F.when(fired, F.col("severity") == band)).alias("severities_fit"),
        F.max("model_name").alias("model_name"),
    )


@query(
    "model_store_round_trip",
    "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_different, CAST(3 AS BIGINT) AS n_registered FROM documents JOIN labels USING (doc_id)",
)
def model_store_round_trip(spark, sf):
    """Scores of models read back from the store are those of the trained ones."""
    rows = labelled_documents(spark, sf)
    folder = scratch_path(spark, "models")
    data = prepare(rows, "toxic", "doc_id", ["n_chars", "n_words", "n_digits"], ["lang"])
    trained = train("isolation_forest", data, "doc_id")
    for _ in range(2):
        train_and_register(data, "doc_id", "isolation_forest", folder, "documents")
    train_and_register(data, "doc_id", "one_class_svm", folder, "documents")
    loaded = score_events(rows, "doc_id", load_active(spark, folder))
    direct = score("isolation_forest", trained, data.steps.apply(rows, "doc_id"))
    both = loaded.join(direct.select("doc_id", F.col("isolation_forest").alias("d")), "doc_id")
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.abs(F.col("isolation_forest") - F.col("d")) > 1e-12).alias("n_different"),
    ).withColumn("n_registered", F.lit(read_registry(spark, folder).count()).cast("long"))


@query(
    "named_set_training",
    """SELECT 'UNSW-NB15' AS training_dataset, count(*) = count(*) FILTER (toxic IS NOT NULL) AS labelled, 'id_like,lang,n_chars,n_words' AS features,
      count(*) FILTER (toxic = 0) AS n_benign, TRUE AS split_fits FROM documents JOIN labels USING (doc_id)""",
)
def named_set_training(spark, sf):
    """A model from a set of that layout: kinds of columns are seen from the data, all attacks are kept for testing or sampled."""
    path, folder = scratch_path(spark, "named-set"), scratch_path(spark, "models")
    rows = labelled_documents(spark, sf).select(
        F.col("doc_id").alias("id"), F.concat(F.lit("d"), F.pmod("doc_id", F.lit(5))).alias("id_like"), "lang", "n_chars", "n_words",
        F.lit("x").alias("attack_cat"), F.col("toxic").cast("int").alias("label"),
    )
    rows.write.option("header", True).csv(path)
    report = train_from_set(spark, "UNSW-NB15", path, "isolation_forest", folder)
    model = read_registry(spark, folder)
    benign = rows.where("label = 0").count()
    train, test = report["training_samples"], report["test_samples"]
    return model.select(
        "training_dataset",
        F.lit(True).alias("labelled"),
        F.array_join(F.array_sort(F.split(F.col("parameters")["features"], ",")), ",").alias("features"),
        F.lit(benign).cast("long").alias("n_benign"),
        ((F.col("training_samples") == train) & F.lit(0 < train <= benign <= train + test)).alias("split_fits"),
    )


@query(
    "event_scoring_run",
    f"""WITH e AS (SELECT 1 FROM events UNION ALL SELECT 1 FROM events)
    SELECT run, count(*) AS events_processed, TRUE AS alerts_are_anomalies, TRUE AS stored_once, 'isolation_forest, autoencoder' AS model_name
    FROM e, (VALUES (1), (2)) r(run) GROUP BY run""",
)
def event_scoring_run(spark, sf):
    """All stored events scored and their alerts kept, twice; of three registered models one is broken and left out."""
    events = all_events(spark, sf)
    folder, path = scratch_path(spark, "models"), scratch_path(spark, "anomaly-alerts")
    data = prepare(stored_features(events).withColumn("label", F.lit(0)), "label", "event_id", ["total_bytes", "dst_port", "cmd_length"])
    for model_type in MODEL_TYPES:
        kept = train_and_register(data, "event_id", model_type, folder, "events")
        if model_type == "one_class_svm":
            delete_path(spark, f"{kept['model_path']}/model")
    out = []
    for run in (1, 2):
        report = score_and_store(events, path, folder, created_at(), threshold=0.3).first()
        stored = spark.read.schema(ALERT_SCHEMA).parquet(path)
        found = stored.agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("e"), F.max("model_name").alias("m")).first()
        out.append((
            run, report["events_processed"], report["anomalies_detected"] == found["n"] > 0, found["n"] == found["e"], found["m"]
        ))
    schema = "run int, events_processed long, alerts_are_anomalies boolean, stored_once boolean, model_name string"
    return spark.createDataFrame(out, schema)
