"""Queries over windows, features, detector scores, evaluation, drift and alert rules (families W, M, E, D, R)."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from vigilspark.catalog.base import (
    DETECTION_SQL, FEATURE_LIST_SQL, ORACLE, STRIDE_S, THRESHOLD, WINDOW_S, anomalies, as_of, chain_sql, checks_sql, feature_rows, feature_table, fixed,
    labelled_series, q, query, r6, raw_telemetry, report_rows, response_rows, rule_alerts, scenarios, scored, series, severity_sql, sql, telemetry, timeline, ts, windowed,
)
from vigilspark.operators import alerts, attribution, detection, drift, evaluation, features, forest, reports, rollups, windows
from vigilspark.operators import series as series_ops
from vigilspark.schema import FEATURE_NAMES, SERIES_FEATURES
from vigilspark.session import materialize

ERR = "level IN ('ERROR', 'CRITICAL')"
T = f"CAST({THRESHOLD} AS DOUBLE)"


# -- windows --------------------------------------------------------------------


@query(
    "window_spine",
    sql(
        f"SELECT {ts('w.window_start')} AS window_start, {ts('w.window_end')} AS window_end, count(event_id) AS n_events FROM wins w "
        "LEFT JOIN tel ON time >= w.window_start AND time < w.window_end GROUP BY w.window_start, w.window_end",
        "wins", "tel",
    ),
)
def window_spine(spark, sf_dir):
    start, end = timeline(spark, sf_dir)
    return windows.counted_windows(raw_telemetry(spark, sf_dir), start, end, WINDOW_S, STRIDE_S)


@query(
    "window_features",
    sql(f"SELECT {ts('window_start')} AS window_start, {ts('window_end')} AS window_end, {FEATURE_LIST_SQL} FROM feat", "feat"),
)
def window_features(spark, sf_dir):
    return feature_rows(spark, sf_dir)


@query(
    "service_features",
    sql(
        f"SELECT {ts('window_start')} AS window_start, {ts('window_end')} AS window_end, service, count(*) AS event_count, "
        f"{r6(f'CAST(count(*) FILTER ({ERR}) AS DOUBLE) / count(*)')} AS error_rate, "
        f"{r6('coalesce(quantile_cont(valid_latency, 0.95), 0)')} AS p95_latency FROM ewin GROUP BY ewin.window_start, ewin.window_end, service",
        "ewin",
    ),
)
def service_features(spark, sf_dir):
    return features.service_features(windowed(spark, sf_dir))


@query(
    "temporal_split",
    sql(
        f"SELECT {ts('window_start')} AS window_start, rank, label, CASE WHEN rank < n_train THEN 'train' WHEN rank < "
        "CASE WHEN least(n_train + n_val, n) = n AND n > n_train THEN n - 1 ELSE least(n_train + n_val, n) END THEN 'val' ELSE 'test' END AS split "
        "FROM (SELECT *, row_number() OVER (ORDER BY window_start) - 1 AS rank, greatest(1, floor(n * 0.6::DOUBLE)) AS n_train, "
        "greatest(1, floor(n * 0.2::DOUBLE)) AS n_val FROM (SELECT window_start, label, count(*) OVER () AS n FROM scored))",
        "scored",
    ),
)
def temporal_split(spark, sf_dir):
    return windows.temporal_split(scored(spark, sf_dir).select("window_start", "label"), 0.6, 0.2)


@query(
    "trailing_buffer",
    sql(
        f"SELECT service, {ts('tick')} AS tick, count(*) AS n, count(*) FILTER ({ERR}) AS errors, max(event_id) AS newest, "
        f"min(event_id) AS oldest, {r6('sum(valid_latency)')} AS sum_latency FROM (SELECT k.tick, e.*, row_number() OVER "
        "(PARTITION BY k.service, k.tick ORDER BY e.time DESC, e.event_id DESC) AS age FROM ticks k JOIN tel e "
        "ON e.service = k.service AND e.time <= k.tick) WHERE age <= 50 GROUP BY service, tick",
        "tel", extra=checks_sql("24 HOUR"), recursive=True,
    ),
)
def trailing_buffer(spark, sf_dir):
    """The last 50 events of a service at checks that events set off, at least a day apart."""
    events = materialize(telemetry(spark, sf_dir).select("event_id", "time", "service", "level", "valid_latency"))
    buffered = windows.trailing_buffer(events, windows.event_checks(events, 86_400), size=50, cell_seconds=3_600)
    return buffered.groupBy("service", "tick").agg(
        F.count("*").alias("n"), F.count_if(F.col("level").isin("ERROR", "CRITICAL")).alias("errors"),
        F.max("event_id").alias("newest"), F.min("event_id").alias("oldest"), F.sum("valid_latency").alias("sum_latency"),
    )


@query("service_detection", DETECTION_SQL)
def service_detection(spark, sf_dir):
    """Checks of each service's newest 50 events at least 6 h apart, scored by the rule, alerts at least a day apart."""
    found = detection.detections(telemetry(spark, sf_dir), 21_600, 50, 10, 86_400, threshold=THRESHOLD)
    return found.select("service", "tick", "window_size", "score", "is_anomaly", "kept")


# -- series ---------------------------------------------------------------------

_IWIN = (
    "iw AS (SELECT z.*, w.wid, w.wid * 30 AS start_i, w.wid * 30 + 60 AS end_i FROM zs z JOIN (SELECT stream, "
    "unnest(range(0, (max(i) + 1 - 60) // 30 + 1)) AS wid FROM serl GROUP BY stream HAVING max(i) + 1 >= 60) w "
    "ON w.stream = z.stream AND z.i >= w.wid * 30 AND z.i < w.wid * 30 + 60)"
)


@query(
    "index_windows",
    sql(
        "SELECT stream, CAST(wid AS BIGINT) AS wid, min(i) AS first_i, max(i) AS last_i, count(*) AS n, max(label) AS label "
        "FROM iw GROUP BY 1, 2",
        "zs", extra=_IWIN,
    ),
)
def index_windows(spark, sf_dir):
    return (
        series_ops.index_windows(labelled_series(spark, sf_dir))
        .groupBy("stream", "wid")
        .agg(F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.count("*").alias("n"), F.max("label").alias("label"))
    )


@query("zscore_series", sql(f"SELECT stream, i, metric, {r6('value')} AS value, label FROM zs", "zs"))
def zscore_series(spark, sf_dir):
    return series_ops.zscore(labelled_series(spark, sf_dir)).select("stream", "i", "metric", "value", "label")


@query("value_cutoff", sql(f"SELECT {r6('quantile_cont(abs(value), 0.95)')} AS cutoff FROM zs", "zs"))
def value_cutoff(spark, sf_dir):
    return series_ops.value_cutoff(series_ops.zscore(materialize(series(spark, sf_dir))))


def _series_features_sql() -> str:
    values = {
        "event_count": "60.0", "error_rate": "er", "p50_latency_ms": "p50", "p95_latency_ms": "p95", "p99_latency_ms": "p99",
        "latency_std": "sd", "hour_of_day": "hod", "p95_p50_ratio": "p95 / (p50 + 1)", "p99_p95_ratio": "p99 / (p95 + 1)",
        "error_count": "60 * er", "log_event_count": "ln(1 + 60)", "log_error_rate": "ln(1 + er * 1000)",
    }
    columns = ", ".join(f"{r6(values[n])} AS {n}" for n in SERIES_FEATURES)
    return sql(
        f"SELECT stream, CAST(wid AS BIGINT) AS wid, {columns}, label FROM (SELECT stream, wid, "
        "CAST(count(*) FILTER (abs(value) > cut) AS DOUBLE) / count(value) AS er, quantile_cont(value, 0.5) AS p50, "
        "quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, stddev_pop(value) AS sd, "
        "max(hour(ts)) FILTER (i = (start_i + end_i) // 2) AS hod, max(label) AS label FROM iw, "
        "(SELECT quantile_cont(abs(value), 0.95) AS cut FROM zs) GROUP BY 1, 2)",
        "zs", extra=_IWIN,
    )


@query("series_features", _series_features_sql())
def series_features(spark, sf_dir):
    normalized = materialize(series_ops.zscore(labelled_series(spark, sf_dir)))
    return series_ops.series_features(normalized, series_ops.value_cutoff(normalized))


@query(
    "stream_split",
    sql(
        "SELECT stream, CASE WHEN pos < a THEN 'train' WHEN pos < a + b THEN 'val' ELSE 'test' END AS split FROM (SELECT *, "
        "greatest(1, floor(n * 0.6::DOUBLE)) AS a, greatest(1, floor(n * 0.2::DOUBLE)) AS b FROM (SELECT stream, count(*) OVER () AS n, "
        "row_number() OVER (ORDER BY md5(stream || ':7'), stream) - 1 AS pos FROM (SELECT DISTINCT stream FROM ser1)))",
        "ser1",
    ),
)
def stream_split(spark, sf_dir):
    return series_ops.split_streams(series(spark, sf_dir), seed=7)


# -- features, rule and forest -----------------------------------------------------


@query(
    "scale_features",
    sql(
        f"SELECT {ts('window_start')} AS window_start, "
        + ", ".join(
            r6(f"({q(n)} - avg({q(n)}) OVER ()) / CASE WHEN stddev_pop({q(n)}) OVER () = 0 THEN 1 ELSE stddev_pop({q(n)}) OVER () END")
            + f" AS {q(n)}"
            for n in FEATURE_NAMES
        )
        + " FROM feat",
        "feat",
    ),
)
def scale_features(spark, sf_dir):
    rows = feature_table(spark, sf_dir).drop("window_end")
    return features.scale(rows, features.fit_scaler(rows))


@query(
    "severity_rule",
    sql(f"SELECT {ts('window_start')} AS window_start, {severity_sql('score', 'error_rate')} AS severity FROM scored", "scored"),
)
def severity_rule(spark, sf_dir):
    return scored(spark, sf_dir).select("window_start", alerts.severity(F.col("score"), F.col("error_rate")).alias("severity"))


_SPLIT = (
    "sp AS (SELECT *, CASE WHEN rank < greatest(1, floor(n * 0.6::DOUBLE)) THEN 'train' WHEN rank < greatest(1, floor(n * 0.6::DOUBLE)) + "
    "greatest(1, floor(n * 0.2::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM (SELECT f.*, l.label, count(*) OVER () AS n, "
    "row_number() OVER (ORDER BY window_start) - 1 AS rank FROM feat f JOIN labels_w l USING (window_start, window_end)))"
)
_CONF = (
    "count(*) FILTER (p = 1 AND label = 1) AS tp, count(*) FILTER (p = 1 AND label = 0) AS fp, "
    "count(*) FILTER (p = 0 AND label = 0) AS tn, count(*) FILTER (p = 0 AND label = 1) AS fn"
)
_PR = (
    "coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall, "
    "coalesce(CAST(fp AS DOUBLE) / nullif(fp + tn, 0), 0) AS fpr, coalesce(CAST(tn AS DOUBLE) / nullif(fp + tn, 0), 0) AS specificity"
)


def _confusion_sql(predicted: str) -> str:
    return (
        f"SELECT tp, fp, tn, fn, {r6('precision')} AS precision, {r6('recall')} AS recall, "
        f"{r6('coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)')} AS f1, {r6('fpr')} AS fpr, "
        f"{r6('specificity')} AS specificity, {r6('(recall + specificity) / 2')} AS balanced_accuracy, "
        f"{r6('coalesce(5 * precision * recall / nullif(4 * precision + recall, 0), 0)')} AS f2, "
        + r6(
            "coalesce((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / nullif(sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0)"
        )
        + f" AS mcc FROM (SELECT *, {_PR} FROM (SELECT {_CONF} FROM ({predicted})))"
    )


def _split_features(spark, sf_dir):
    labelled = windows.label_windows(feature_table(spark, sf_dir), scenarios(spark, sf_dir))
    return windows.temporal_split(labelled, 0.6, 0.2)


@query(
    "rule_baseline",
    sql(
        _confusion_sql(
            "SELECT label, CAST(error_rate > 0.22::DOUBLE OR p95_latency_ms > 1.2::DOUBLE * "
            "(SELECT quantile_cont(p95_latency_ms, 0.5) FROM sp WHERE split = 'train') AS INT) AS p FROM sp WHERE split IN ('val', 'test')"
        ),
        "feat", "labels_w", extra=_SPLIT,
    ),
)
def rule_baseline(spark, sf_dir):
    rows = materialize(_split_features(spark, sf_dir))
    baseline = alerts.rule_baseline(rows.where("split = 'train'"))
    tested = rows.where(F.col("split").isin("val", "test"))
    return evaluation.confusion_of(alerts.rule_detector(tested, baseline, 0.22, 1.2))


@query(
    "alert_records",
    sql(
        f"SELECT 'anomaly_' || service || '_' || (epoch_us(newest) // 1000000) AS id, service, {ts('newest')} AS timestamp, "
        f"{severity_sql('score', 'er')} AS severity, {r6('score')} AS score, n AS window_size, {ts('oldest')} AS window_start, "
        f"{ts('newest')} AS window_end, {r6('er')} AS error_rate, CAST(2 AS INT) AS n_features FROM (SELECT *, round(0.05::DOUBLE - er, 6) AS score FROM "
        f"(SELECT time_bucket(INTERVAL 6 HOUR, time) AS w, service, count(*) AS n, CAST(count(*) FILTER ({ERR}) AS DOUBLE) / count(*) AS er, "
        "min(time) AS oldest, max(time) AS newest FROM tel GROUP BY 1, 2)) WHERE score < -0.2::DOUBLE",
        "tel",
    ),
)
def alert_records(spark, sf_dir):
    grouped = (
        raw_telemetry(spark, sf_dir)
        .groupBy(F.window("time", "6 hours").alias("w"), "service")
        .agg(
            F.count("*").alias("window_size"),
            F.avg(F.col("level").isin("ERROR", "CRITICAL").cast("double")).alias("error_rate"),
            F.min("time").alias("window_start"),
            F.max("time").alias("window_end"),
        )
        .withColumn("event_count", F.col("window_size").cast("double"))
        .withColumn("score", F.round(F.lit(0.05) - F.col("error_rate"), 6))
        .withColumn("threshold", F.lit(-0.2))
        .withColumn("detected_at", F.col("window_end"))
        .where("score < threshold")
    )
    out = alerts.alert_records(grouped, ("event_count", "error_rate"))
    return out.select(
        "id", "service", "timestamp", "severity", "score", "window_size", "window_start", "window_end",
        F.element_at("features", "error_rate").alias("error_rate"), F.size("features").alias("n_features"),
    )


@query(
    "model_age",
    sql(
        f"SELECT service, {ts('trained')} AS training_date, {r6('greatest(0, (epoch_us(t) - epoch_us(trained)) / 86400e6)')} AS age_days, "
        "(epoch_us(t) - epoch_us(trained)) / 86400e6 > 30 AS stale FROM (SELECT service, min(time) - INTERVAL 1 DAY AS trained FROM tel GROUP BY 1), latest",
        "tel", "latest",
    ),
)
def model_age(spark, sf_dir):
    models = raw_telemetry(spark, sf_dir).groupBy("service").agg((F.min("time") - F.expr("INTERVAL 1 DAY")).alias("training_date"))
    return alerts.model_age(models, as_of(spark, sf_dir))


def _long_attributions(spark, sf_dir):
    """Scaled features over 27 as stand-in attributions: they check ranking and sums, not Shapley values."""
    rows = feature_table(spark, sf_dir).drop("window_end")
    z = features.scale(rows, features.fit_scaler(rows))
    raw = features.unpivot_features(rows, ["window_start"])
    shap = features.unpivot_features(z, ["window_start"]).select("window_start", "feature", F.round(-F.col("value") / 27, 6).alias("shap"))
    return raw.join(shap, ["window_start", "feature"])


_ATTR_LONG = (
    "fl AS (UNPIVOT feat ON " + ", ".join(q(n) for n in FEATURE_NAMES) + " INTO NAME feature VALUE value), "
    "sh AS (SELECT *, round(-((value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w = 0 THEN 1 ELSE stddev_pop(value) OVER w END) / 27, 6) "
    "AS shap FROM fl WINDOW w AS (PARTITION BY feature))"
)


@query(
    "shap_top_k",
    sql(
        f"SELECT {ts('window_start')} AS window_start, feature, {r6('value')} AS value, {r6('shap')} AS shap, CAST(rank AS INT) AS rank, "
        "CASE WHEN shap < 0 THEN 'toward_anomaly' ELSE 'toward_normal' END AS direction FROM (SELECT *, row_number() OVER "
        "(PARTITION BY window_start ORDER BY abs(shap) DESC, feature) AS rank FROM sh) WHERE rank <= 3",
        "feat", extra=_ATTR_LONG,
    ),
)
def shap_top_k(spark, sf_dir):
    return attribution.ranked_attributions(_long_attributions(spark, sf_dir), ["window_start"], 3)


@query(
    "shap_summary",
    sql(
        f"SELECT {ts('window_start')} AS window_start, {r6('neg')} AS negative_sum, {r6('pos')} AS positive_sum, {r6('neg + pos')} AS net, "
        "concat_ws(chr(10), 'Anomaly Detection Explanation:' || chr(10), 'Top factors indicating ANOMALY:' || chr(10) || nt || chr(10), "
        "'Top factors indicating NORMAL:' || chr(10) || pt || chr(10), 'Net SHAP impact: ' || "
        f"{fixed('neg + pos', 4)}, '  Anomaly factors: ' || {fixed('neg', 4)}, '  Normal factors:  +' || {fixed('pos', 4)}) AS text FROM "
        "(SELECT window_start, coalesce(sum(shap) FILTER (shap < 0), 0) AS neg, coalesce(sum(shap) FILTER (shap > 0), 0) AS pos, "
        f"string_agg('  - ' || feature || ': ' || {fixed('shap', 4)}, chr(10) ORDER BY rank) FILTER (shap < 0) AS nt, "
        f"string_agg('  - ' || feature || ': +' || {fixed('shap', 4)}, chr(10) ORDER BY rank) FILTER (shap > 0) AS pt FROM "
        "(SELECT *, row_number() OVER (PARTITION BY window_start, shap < 0 ORDER BY abs(shap) DESC, feature) AS rank FROM sh WHERE shap <> 0) "
        "WHERE rank <= 5 GROUP BY 1)",
        "feat", extra=_ATTR_LONG,
    ),
)
def shap_summary(spark, sf_dir):
    return attribution.attribution_summary(_long_attributions(spark, sf_dir), ["window_start"])


def _forest(spark, sf_dir):
    rows = materialize(_split_features(spark, sf_dir))
    train = rows.where("split = 'train' AND label = 0")
    model = forest.fit(train, "window_start", threshold=0.0, trained_at=as_of(spark, sf_dir))
    return rows, model


#: Rows that the forest is fitted on, and how many scores lie under the interpolated quantile of a share of them.
_CLEAN = _SPLIT + ", clean AS (SELECT window_start, count(*) OVER () AS n FROM sp WHERE split = 'train' AND label = 0)"


def _under(share: str) -> str:
    return f"CAST(ceil(round((n - 1) * {share}::DOUBLE, 9)) AS BIGINT)"


@query(
    "forest_fit",
    sql(
        "SELECT CAST(tree AS INT) AS tree, CAST(least(256, n) AS BIGINT) AS root_rows, CAST(least(256, n) AS BIGINT) AS leaf_rows, true AS shape_ok "
        "FROM (SELECT DISTINCT n FROM clean), (SELECT unnest(range(0, 100)) AS tree)",
        "feat", "labels_w", extra=_CLEAN,
    ),
)
def forest_fit(spark, sf_dir):
    """Per tree: rows at the root and in all leaves, and whether depth and number of nodes fit a binary tree."""
    leaf = F.col("feature") < 0
    nodes = _forest(spark, sf_dir)[1].nodes.groupBy("tree").agg(
        F.max(F.when(F.col("node") == 0, F.col("n"))).cast("bigint").alias("root_rows"),
        F.sum(F.when(leaf, F.col("n"))).cast("bigint").alias("leaf_rows"),
        ((F.max("depth") <= 8) & (F.count("*") == 2 * F.count_if(leaf) - 1)).alias("shape_ok"),
    )
    return nodes.withColumn("tree", F.col("tree").cast("int"))


@query(
    "forest_scores",
    sql(f"SELECT {ts('window_start')} AS window_start, split, label, true AS in_range FROM sp", "feat", "labels_w", extra=_SPLIT),
)
def forest_scores(spark, sf_dir):
    """Every window is scored: between -1 and 0 before the offset, and flagged if below the threshold."""
    rows, model = _forest(spark, sf_dir)
    raw = F.col("score") + F.lit(model.meta.first()["offset"])
    ok = raw.between(-1.0, 0.0) & (F.col("is_anomaly") == (F.col("score") < F.col("threshold")))
    return forest.score(rows, model).select("window_start", "split", "label", ok.alias("in_range"))


@query(
    "forest_background",
    sql(
        "SELECT CAST(window_start AS VARCHAR) AS key FROM clean ORDER BY md5(CAST(window_start AS VARCHAR) || ':42'), key LIMIT 100",
        "feat", "labels_w", extra=_CLEAN,
    ),
)
def forest_background(spark, sf_dir):
    return _forest(spark, sf_dir)[1].background.select("key")


@query(
    "forest_training_stats",
    sql(f"SELECT n AS n_windows, {_under('0.05')} AS anomalies_in_training, true AS ordered FROM (SELECT DISTINCT n FROM clean)", "feat", "labels_w", extra=_CLEAN),
)
def forest_training_stats(spark, sf_dir):
    """On the rows the model was fitted on, as many are flagged as its contamination says."""
    rows, model = _forest(spark, sf_dir)
    stats = forest.training_stats(forest.score(rows.where("split = 'train' AND label = 0"), model))
    ordered = (F.col("score_min") <= F.col("score_mean")) & (F.col("score_mean") <= F.col("score_max")) & (F.col("score_std") >= 0)
    return stats.select("n_windows", "anomalies_in_training", ordered.alias("ordered"))


@query(
    "contamination_runs",
    sql(
        f"SELECT c AS contamination, {_under('c')} AS flagged FROM (SELECT DISTINCT n FROM clean), (SELECT unnest([0.01, 0.05, 0.1])::DOUBLE AS c)",
        "feat", "labels_w", extra=_CLEAN,
    ),
)
def contamination_runs(spark, sf_dir):
    """How many training rows lie under the offset of each contamination."""
    rows, model = _forest(spark, sf_dir)
    clean = rows.where("split = 'train' AND label = 0")
    runs = forest.contamination_runs(clean, model, (0.01, 0.05, 0.1))
    raw = forest.score(clean, model).select((F.col("score") + F.lit(model.meta.first()["offset"])).alias("raw"))
    both = raw.withColumn("runs", runs.agg(F.collect_list(F.struct("contamination", "offset"))).scalar())  # three entries
    return both.select("raw", F.inline("runs")).groupBy("contamination").agg(F.count_if(F.col("raw") < F.col("offset")).alias("flagged"))


@query(
    "shap_values",
    sql(f"SELECT {ts('window_start')} AS window_start, 0.0::DOUBLE AS residual, 27 AS n_values FROM sp", "feat", "labels_w", extra=_SPLIT),
)
def shap_values(spark, sf_dir):
    """Attributions of every window; with the base value they add up to its mean path length."""
    rows, model = _forest(spark, sf_dir)
    meta = model.meta.first()
    path = -F.log2(-(F.col("score") + F.lit(meta["offset"]))) * F.lit(float(forest.average_path(meta["psi"])))
    told = F.aggregate("shap", F.col("base_value"), lambda s, x: s + x)
    out = attribution.attribute(forest.score(rows, model), model, flagged_only=False)
    return out.select("window_start", F.round(F.abs(told - path), 6).alias("residual"), F.size("shap").alias("n_values"))


@query("detector_comparison")
def detector_comparison(spark, sf_dir):
    rows, model = _forest(spark, sf_dir)
    baseline = alerts.rule_baseline(rows.where("split = 'train' AND label = 0"))
    tested = rows.where("split = 'test'")
    rule = evaluation.confusion_of(alerts.rule_detector(tested, baseline, 0.22, 1.2))
    return evaluation.compare_detectors(rule, evaluation.confusion(forest.score(tested, model), 0.0))


# -- evaluation --------------------------------------------------------------------


@query("confusion", sql(_confusion_sql(f"SELECT label, CAST(score < {T} AS INT) AS p FROM scored"), "scored"))
def confusion(spark, sf_dir):
    return evaluation.confusion(scored(spark, sf_dir), THRESHOLD)


_GRID = (
    "grid(k, threshold) AS (SELECT 0, CAST(-1.0 AS DOUBLE) UNION ALL SELECT k + 1, threshold + CAST(0.02 AS DOUBLE) FROM grid "
    "WHERE threshold + CAST(0.02 AS DOUBLE) <= 0.5::DOUBLE + 1e-9::DOUBLE), "
    "sw AS (SELECT threshold, tp, fp, tn, fn, " + _PR + " FROM (SELECT threshold, "
    + _CONF + " FROM (SELECT g.threshold, s.label, CAST(s.score < g.threshold AS INT) AS p FROM grid g, scored s) GROUP BY threshold))"
)


@query(
    "threshold_sweep",
    sql(
        f"SELECT {r6('threshold')} AS threshold, tp, fp, tn, fn, {r6('precision')} AS precision, {r6('recall')} AS recall, "
        f"{r6('coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)')} AS f1, {r6('fpr')} AS fpr FROM sw",
        "scored", extra=_GRID, recursive=True,
    ),
)
def threshold_sweep(spark, sf_dir):
    swept = evaluation.threshold_sweep(scored(spark, sf_dir))
    return swept.select(*[F.col(c).cast("bigint") if c in ("tp", "fp", "tn", "fn") else F.col(c) for c in swept.columns])


@query(
    "fbeta_points",
    sql(
        f"SELECT {r6('beta')} AS beta, {r6('threshold')} AS threshold, {r6('f')} AS f_score, {r6('precision')} AS precision, {r6('recall')} AS recall FROM "
        "(SELECT *, row_number() OVER (PARTITION BY beta ORDER BY f DESC, threshold) AS rk FROM (SELECT beta, threshold, precision, recall, "
        "coalesce((1 + beta * beta) * precision * recall / nullif(beta * beta * precision + recall, 0), 0) AS f FROM sw, "
        "(SELECT unnest([0.5::DOUBLE, 1, 2]) AS beta))) WHERE rk = 1",
        "scored", extra=_GRID, recursive=True,
    ),
)
def fbeta_points(spark, sf_dir):
    return evaluation.fbeta_points(evaluation.threshold_sweep(scored(spark, sf_dir)))


@query(
    "roc_auc",
    sql(
        f"SELECT {r6('sum(CASE WHEN a.score < b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*)')} AS roc_auc "
        "FROM scored a, scored b WHERE a.label = 1 AND b.label = 0",
        "scored",
    ),
)
def roc_auc(spark, sf_dir):
    return evaluation.roc_auc(scored(spark, sf_dir))


_LEVELS = (
    "lv AS (SELECT score, sum(pos) OVER (ORDER BY score) AS tp, sum(neg) OVER (ORDER BY score) AS fp, pos, sum(pos) OVER () AS p, sum(neg) OVER () AS n "
    "FROM (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored GROUP BY 1))"
)


@query(
    "pr_auc",
    sql(f"SELECT {r6('sum(CAST(pos AS DOUBLE) / p * (CAST(tp AS DOUBLE) / (tp + fp)))')} AS pr_auc FROM lv", "scored", extra=_LEVELS),
)
def pr_auc(spark, sf_dir):
    return evaluation.pr_auc(scored(spark, sf_dir))


@query(
    "roc_points",
    sql(
        f"SELECT {r6('score')} AS threshold, {r6('CAST(fp AS DOUBLE) / n')} AS fpr, {r6('CAST(tp AS DOUBLE) / p')} AS tpr FROM lv",
        "scored", extra=_LEVELS,
    ),
)
def roc_points(spark, sf_dir):
    return evaluation.roc_points(scored(spark, sf_dir))


@query(
    "pr_points",
    sql(
        f"SELECT {r6('score')} AS threshold, {r6('CAST(tp AS DOUBLE) / (tp + fp)')} AS precision, {r6('CAST(tp AS DOUBLE) / p')} AS recall FROM lv",
        "scored", extra=_LEVELS,
    ),
)
def pr_points(spark, sf_dir):
    return evaluation.pr_points(scored(spark, sf_dir))


_DET = (
    "det AS (SELECT c.scenario_id, c.type, count(s.score) AS total, "
    f"count(*) FILTER (s.score < {T}) AS caught, (epoch_us(min(s.window_start) FILTER (s.score < {T})) - epoch_us(c.start_ts)) / 1e6 AS lat "
    "FROM scen c LEFT JOIN scored s ON c.start_ts < s.window_end AND c.end_ts > s.window_start GROUP BY c.scenario_id, c.type, c.start_ts)"
)


def _detections(spark, sf_dir):
    return evaluation.scenario_detection(scenarios(spark, sf_dir), scored(spark, sf_dir), THRESHOLD)


@query(
    "recall_by_type",
    sql(
        "SELECT type, CAST(sum(caught) AS BIGINT) AS caught, CAST(sum(total) AS BIGINT) AS total, "
        f"{r6('CAST(sum(caught) AS DOUBLE) / nullif(sum(total), 0)')} AS recall, CASE WHEN CAST(sum(caught) AS DOUBLE) / nullif(sum(total), 0) >= 0.8 "
        "THEN 'reliable' WHEN CAST(sum(caught) AS DOUBLE) / nullif(sum(total), 0) < 0.5 THEN 'missed' WHEN sum(total) = 0 THEN 'n/a' ELSE 'partial' END "
        "AS recall_class FROM det GROUP BY 1",
        "scen", "scored", extra=_DET,
    ),
)
def recall_by_type(spark, sf_dir):
    return evaluation.recall_classes(evaluation.recall_by_type(_detections(spark, sf_dir)))


@query(
    "latency_cdf",
    sql(
        f"SELECT scenario_id, {r6('lat')} AS detection_latency_s, "
        f"{r6('row_number() OVER (ORDER BY lat, scenario_id)::DOUBLE / count(*) OVER ()')} AS share FROM det WHERE lat IS NOT NULL",
        "scen", "scored", extra=_DET,
    ),
)
def latency_cdf(spark, sf_dir):
    return evaluation.latency_cdf(_detections(spark, sf_dir))


@query(
    "latency_summary",
    sql(
        f"SELECT count(*) AS scenarios_total, count(*) FILTER (caught > 0) AS scenarios_caught, {r6('quantile_cont(lat, 0.5)')} AS median_latency_s, "
        f"{r6('quantile_cont(lat, 0.9)')} AS p90_latency_s FROM det",
        "scen", "scored", extra=_DET,
    ),
)
def latency_summary(spark, sf_dir):
    return evaluation.latency_summary(_detections(spark, sf_dir))


_OPS = (
    f"ops AS (SELECT count(*) FILTER (label = 0 AND score < {T}) AS false_alarms, count(*) FILTER (label = 0) AS clean_windows, "
    "avg(score) FILTER (label = 1) AS m1, avg(score) FILTER (label = 0) AS m0, var_pop(score) FILTER (label = 1) AS v1, "
    "var_pop(score) FILTER (label = 0) AS v0 FROM scored)"
)


@query(
    "operational_stats",
    sql(
        f"SELECT false_alarms, clean_windows, {r6('false_alarms / (clean_windows * 6.0::DOUBLE)')} AS false_alarm_rate_per_hour, "
        f"{r6('m1')} AS mean_score_anomaly, {r6('m0')} AS mean_score_normal, {r6('abs(m1 - m0) / sqrt(0.5::DOUBLE * (v1 + v0))')} AS score_separability "
        "FROM ops",
        "scored", extra=_OPS,
    ),
)
def operational_stats(spark, sf_dir):
    return evaluation.operational_stats(scored(spark, sf_dir), THRESHOLD, WINDOW_S)


@query(
    "metric_grades",
    sql(
        f"SELECT metric, {r6('value')} AS value, {r6('good')} AS good, {r6('decent')} AS decent, true AS higher_is_better, "
        "CASE WHEN value >= good THEN 'GOOD' WHEN value >= decent THEN 'DECENT' ELSE 'POOR' END AS grade FROM ("
        "SELECT 'pr_auc' AS metric, sum(CAST(pos AS DOUBLE) / p * (CAST(tp AS DOUBLE) / (tp + fp))) AS value, 0.7 AS good, 0.5 AS decent FROM lv UNION ALL "
        "SELECT 'roc_auc', (SELECT sum(CASE WHEN a.score < b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*) FROM scored a, scored b "
        "WHERE a.label = 1 AND b.label = 0), 0.85, 0.7 UNION ALL SELECT 'f1', 2.0::DOUBLE * count(*) FILTER (label = 1 AND "
        f"score < {T}) / (count(*) FILTER (label = 1) + count(*) FILTER (score < {T})), 0.6, 0.4 FROM scored)",
        "scored", extra=_LEVELS,
    ),
)
def metric_grades(spark, sf_dir):
    return evaluation.metric_grades(_metrics_row(spark, sf_dir))


def _metrics_row(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return (
        evaluation.confusion(rows, THRESHOLD)
        .withColumn("pr_auc", evaluation.pr_auc(rows).scalar())
        .withColumn("roc_auc", evaluation.roc_auc(rows).scalar())
    )


def _verdict_sql() -> str:
    grade = lambda c, good, fair: f"CASE WHEN {c} >= {good} THEN 2 WHEN {c} >= {fair} THEN 1 ELSE 0 END"
    parts = " , ".join(f"({ORACLE[n]}) t{i}" for i, n in enumerate(("confusion", "pr_auc", "roc_auc", "operational_stats", "latency_summary")))
    mean = r6("avg(label)")
    return (
        "SELECT * EXCLUDE (pr, fg), CASE WHEN pr = 2 AND fg > 0 THEN 'works_well' WHEN pr > 0 AND fg > 0 THEN 'mostly_works' WHEN pr_auc > anomaly_rate * 1.5 "
        "THEN 'weak_signal' ELSE 'does_not_work' END AS headline, CASE WHEN false_alarm_rate_per_hour > 5 THEN 'high' WHEN false_alarm_rate_per_hour > 1 "
        "THEN 'moderate' ELSE 'low' END AS false_alarm_class, CASE WHEN scenarios_caught = 0 THEN 'none_detected' WHEN median_latency_s < 120 THEN 'fast' "
        "WHEN median_latency_s < 300 THEN 'acceptable' ELSE 'slow' END AS latency_class, CASE WHEN score_separability >= 2 THEN 'strong' WHEN "
        "score_separability >= 1 THEN 'moderate' ELSE 'weak' END AS separation_class FROM (SELECT f1, pr_auc, roc_auc, anomaly_rate, t3.*, t4.*, "
        f"{grade('pr_auc', 0.7, 0.5)} AS pr, {grade('f1', 0.6, 0.4)} AS fg FROM {parts}, ({sql(f'SELECT {mean} AS anomaly_rate FROM scored', 'scored')}) t9)"
    )


@query("detector_verdict", _verdict_sql())
def detector_verdict(spark, sf_dir):
    rows = scored(spark, sf_dir)
    ops = evaluation.operational_stats(rows, THRESHOLD, WINDOW_S).select(F.struct("*"))
    late = evaluation.latency_summary(evaluation.scenario_detection(scenarios(spark, sf_dir), rows, THRESHOLD)).select(F.struct("*"))
    metrics = (
        evaluation.confusion(rows, THRESHOLD)
        .withColumn("pr_auc", evaluation.pr_auc(rows).scalar())
        .withColumn("roc_auc", evaluation.roc_auc(rows).scalar())
        .withColumn("anomaly_rate", rows.agg(F.avg(F.col("label").cast("double"))).scalar())
        .withColumn("_o", ops.scalar())
        .withColumn("_l", late.scalar())
        .select("f1", "pr_auc", "roc_auc", "anomaly_rate", "_o.*", "_l.*")
    )
    return evaluation.verdict(metrics)


@query(
    "split_summary",
    sql(
        f"SELECT split, count(*) AS n, count(*) FILTER (label = 1) AS positives, {r6('avg(label)')} AS anomaly_rate, {r6('avg(score)')} AS score_mean, "
        f"{r6('stddev_pop(score)')} AS score_std, {r6('min(score)')} AS score_min, {r6('max(score)')} AS score_max FROM "
        "(SELECT *, CASE WHEN rank < greatest(1, floor(n * 0.6::DOUBLE)) THEN 'train' WHEN rank < greatest(1, floor(n * 0.6::DOUBLE)) + "
        "greatest(1, floor(n * 0.2::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM (SELECT score, label, count(*) OVER () AS n, "
        "row_number() OVER (ORDER BY window_start) - 1 AS rank FROM scored)) GROUP BY 1",
        "scored",
    ),
)
def split_summary(spark, sf_dir):
    return evaluation.split_summary(windows.temporal_split(scored(spark, sf_dir), 0.6, 0.2))


@query(
    "score_histogram",
    sql(
        "SELECT CAST(least(38, floor((score - lo) / (hi - lo) * 39)) AS INT) AS bin, label, count(*) AS n FROM scored, "
        "(SELECT min(score) AS lo, max(score) AS hi FROM scored) GROUP BY 1, 2",
        "scored",
    ),
)
def score_histogram(spark, sf_dir):
    return evaluation.score_histogram(scored(spark, sf_dir))


# -- drift -------------------------------------------------------------------------

_DRIFT = (
    "fl AS (UNPIVOT feat ON " + ", ".join(q(n) for n in FEATURE_NAMES) + " INTO NAME feature VALUE value), "
    "cut AS (SELECT s + (e - s) / 2 AS c FROM tl), "
    "raw_e AS (SELECT feature, quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS e FROM fl, cut WHERE window_start < c GROUP BY 1), "
    "ed AS (SELECT feature, list_reduce(list_transform(e, lambda x: [x]), lambda a, b: list_concat(a, "
    "[CASE WHEN b[1] <= a[len(a)] THEN a[len(a)] + 1e-9::DOUBLE ELSE b[1] END])) AS edges FROM raw_e), "
    "binned AS (SELECT f.feature, f.window_start < c AS is_ref, CAST(len(list_filter(edges[2:10], lambda x: x <= f.value)) AS INT) AS bin "
    "FROM fl f JOIN ed USING (feature), cut), "
    "spine AS (SELECT feature, CAST(unnest(range(0, 10)) AS INT) AS bin FROM ed), "
    "pb AS (SELECT s.feature, s.bin, CAST(count(b.bin) FILTER (b.is_ref) AS DOUBLE) / (SELECT count(*) FROM binned x WHERE x.feature = s.feature AND x.is_ref) "
    "+ 1e-6::DOUBLE AS ref_share, CAST(count(b.bin) FILTER (NOT b.is_ref) AS DOUBLE) / (SELECT count(*) FROM binned x WHERE x.feature = s.feature AND NOT x.is_ref) "
    "+ 1e-6::DOUBLE AS cur_share FROM spine s LEFT JOIN binned b ON b.feature = s.feature AND b.bin = s.bin GROUP BY 1, 2)"
)


def _two_halves(spark, sf_dir):
    """Long features of the first and the second half of the timeline."""
    start, end = timeline(spark, sf_dir)
    middle = F.lit(start + (end - start) / 2)
    long = features.unpivot_features(feature_table(spark, sf_dir).drop("window_end"), ["window_start"])
    return long.where(F.col("window_start") < middle), long.where(F.col("window_start") >= middle)


@query(
    "psi_edges",
    sql(
        f"SELECT feature, array_to_string(list_transform(edges, lambda x: printf('%.5f', x)), ',') AS edges FROM ed", "feat", "tl", extra=_DRIFT
    ),
)
def psi_edges(spark, sf_dir):
    edges = drift.quantile_edges(_two_halves(spark, sf_dir)[0])
    return edges.select("feature", F.array_join(F.transform("edges", lambda e: F.format_string("%.5f", e)), ",").alias("edges"))


@query(
    "psi_bins",
    sql(f"SELECT feature, bin, {r6('ref_share')} AS ref_share, {r6('cur_share')} AS cur_share FROM pb", "feat", "tl", extra=_DRIFT),
)
def psi_bins(spark, sf_dir):
    return drift.drift_bins(*_two_halves(spark, sf_dir))


@query(
    "psi",
    sql(
        f"SELECT feature, {r6('psi')} AS psi, CASE WHEN psi >= 0.25 THEN 'major' WHEN psi >= 0.1 THEN 'minor' ELSE 'ok' END AS severity FROM "
        "(SELECT feature, sum((cur_share - ref_share) * ln(cur_share / ref_share)) AS psi FROM pb GROUP BY 1)",
        "feat", "tl", extra=_DRIFT,
    ),
)
def psi(spark, sf_dir):
    return drift.psi(*_two_halves(spark, sf_dir))


@query(
    "psi_max",
    sql(
        f"SELECT {r6('max(psi)')} AS max_psi, max(psi) > 0.25 AS failed FROM "
        "(SELECT feature, sum((cur_share - ref_share) * ln(cur_share / ref_share)) AS psi FROM pb GROUP BY 1)",
        "feat", "tl", extra=_DRIFT,
    ),
)
def psi_max(spark, sf_dir):
    return drift.max_psi(drift.psi(*_two_halves(spark, sf_dir)))


@query(
    "feature_quantiles",
    sql(
        f"SELECT {ts('b')} AS bucket, feature, {r6('quantile_cont(value, 0.5)')} AS p50, {r6('quantile_cont(value, 0.95)')} AS p95 FROM "
        "(SELECT CAST(date_trunc('day', window_start) AS TIMESTAMP) AS b, feature, value FROM fl) GROUP BY b, feature",
        "feat",
        extra="fl AS (UNPIVOT feat ON " + ", ".join(q(n) for n in FEATURE_NAMES) + " INTO NAME feature VALUE value)",
    ),
)
def feature_quantiles(spark, sf_dir):
    rows = feature_rows(spark, sf_dir).drop("window_end").withColumnRenamed("window_start", "time")
    return drift.feature_quantiles(features.unpivot_features(rows, ["time"]), "1 day")


# -- alert rules -------------------------------------------------------------------


@query(
    "alert_cooldown",
    sql(
        f"SELECT service, {ts('time')} AS time, anomaly_id FROM kept JOIN alr USING (service, time)",
        "alr", recursive=True,
        extra="kept AS (SELECT service, min(time) AS time FROM alr GROUP BY 1 UNION ALL SELECT k.service, "
        "(SELECT min(a.time) FROM alr a WHERE a.service = k.service AND a.time >= k.time + INTERVAL 1 HOUR) FROM kept k WHERE EXISTS "
        "(SELECT 1 FROM alr a WHERE a.service = k.service AND a.time >= k.time + INTERVAL 1 HOUR))",
    ),
)
def alert_cooldown(spark, sf_dir):
    """One hour of cooldown: the test table's error events of a service are minutes to hours apart."""
    return alerts.suppress_repeats(rule_alerts(spark, sf_dir), 3_600).select("service", "time", "anomaly_id")


def _notice_sql() -> str:
    gap = "CASE WHEN severity = 'critical' THEN INTERVAL 1 HOUR ELSE INTERVAL 4 HOUR END"
    later = f"a.service = k.service AND a.severity = k.severity AND a.time >= k.time + {gap.replace('severity', 'k.severity')}"
    return sql(
        f"SELECT alertname, service, severity, {ts('time')} AS time, anomaly_id FROM kept JOIN alr USING (service, severity, time)",
        "alr", recursive=True,
        extra="kept AS (SELECT service, severity, min(time) AS time FROM alr GROUP BY 1, 2 UNION ALL SELECT k.service, k.severity, "
        f"(SELECT min(a.time) FROM alr a WHERE {later}) FROM kept k WHERE EXISTS (SELECT 1 FROM alr a WHERE {later}))",
    )


@query("alert_repeat", _notice_sql())
def alert_repeat(spark, sf_dir):
    return alerts.alert_notices(rule_alerts(spark, sf_dir)).select("alertname", "service", "severity", "time", "anomaly_id")


_MINUTE_ERRORS = (
    "hr AS (SELECT time_bucket(INTERVAL 1 HOUR, time) AS tick, service, "
    f"CAST(count(*) FILTER ({ERR}) AS DOUBLE) / count(*) AS value FROM tel GROUP BY 1, 2)"
)


def _hold_sql(source: str, keys: str, hold: str, step: str = "3600") -> str:
    """States of rule evaluations (tick, holds): a false or a missing one breaks the hold time."""
    w = f"(PARTITION BY {keys} ORDER BY tick)"
    return (
        f"(SELECT *, CASE WHEN firing THEN 'firing' WHEN coalesce(lag(firing) OVER {w}, false) THEN 'resolved' WHEN holds THEN 'pending' "
        f"ELSE 'inactive' END AS state FROM (SELECT *, holds AND epoch(tick) - epoch(since) >= {hold} AS firing FROM "
        f"(SELECT *, min(CASE WHEN holds THEN tick END) OVER (PARTITION BY {keys}, island) AS since FROM "
        f"(SELECT *, sum(CASE WHEN holds AND NOT gap THEN 0 ELSE 1 END) OVER {w} AS island FROM "
        f"(SELECT *, coalesce(epoch(tick) - epoch(lag(tick) OVER {w}) > {step}, false) AS gap FROM {source})))))"
    )


@query(
    "alert_hold",
    sql(
        f"SELECT service, {ts('tick')} AS tick, holds, {ts('CASE WHEN holds THEN since END')} AS pending_since, firing, state FROM "
        + _hold_sql("(SELECT service, tick, value > 0.15::DOUBLE AS holds FROM hr)", "service", "7200"),
        "tel", extra=_MINUTE_ERRORS,
    ),
)
def alert_hold(spark, sf_dir):
    """Error rate of an hour over 15 % for two hours; hours without events are not evaluated and break the hold."""
    hourly = (
        raw_telemetry(spark, sf_dir)
        .groupBy(F.window("time", "1 hour")["start"].alias("tick"), "service")
        .agg(F.avg(F.col("level").isin("ERROR", "CRITICAL").cast("double")).alias("value"))
        .select("service", "tick", (F.col("value") > 0.15).alias("holds"))
    )
    return alerts.hold(hourly, ["service"], 7_200, 3_600)


#: Rules of the fixture, evaluated every hour: (alertname, severity, hold seconds).
_RULES = (("ServiceDown", "critical", 3_600), ("HighErrorRate", "warning", 0), ("HighLatency", "warning", 3_600))
_EVALUATIONS = (
    "tk AS (SELECT unnest(generate_series(s, e - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS tick FROM tl), "
    f"h1 AS (SELECT time_bucket(INTERVAL 1 HOUR, time) AS tick, service, count(*) AS n, count(*) FILTER ({ERR}) AS bad, max(latency_ms) AS worst "
    "FROM tel GROUP BY 1, 2), "
    "h AS (SELECT k.service, tk.tick, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad, coalesce(worst, 0) AS worst FROM "
    "(SELECT DISTINCT service FROM tel) k CROSS JOIN tk LEFT JOIN h1 ON h1.service = k.service AND h1.tick = tk.tick), "
    "ev AS (SELECT 'ServiceDown' AS alertname, 'critical' AS severity, 3600 AS hold_s, service, tick, n = 0 AS holds FROM h UNION ALL "
    "SELECT 'HighErrorRate', 'warning', 0, service, tick, bad > n * 0.2::DOUBLE FROM h UNION ALL "
    "SELECT 'HighLatency', 'warning', 3600, service, tick, worst > 100 FROM h), "
    "held AS (SELECT * FROM " + _hold_sql("ev", "alertname, service", "hold_s") + "), "
    "spans AS (SELECT service, min(tick) AS a, max(tick) + INTERVAL 1 HOUR AS b FROM held WHERE firing AND severity = 'critical' GROUP BY service, since), "
    "asked AS (SELECT alertname, service, severity, tick AS time FROM held h WHERE firing AND NOT (severity = 'warning' AND EXISTS "
    "(SELECT 1 FROM spans p WHERE p.service = h.service AND h.tick >= p.a AND h.tick < p.b))), "
    "slow AS (SELECT * FROM asked WHERE severity = 'warning'), fast AS (SELECT * FROM asked WHERE severity = 'critical'), "
    + chain_sql("k1", "slow", "alertname, service, severity", "4 HOUR") + ", " + chain_sql("k2", "fast", "alertname, service, severity", "1 HOUR")
)


def _evaluations(spark, sf_dir):
    """Three rules for every service and hour of the timeline, hours without events included."""
    start, end = timeline(spark, sf_dir)
    ticks = alerts.spine(spark, start, end - timedelta(hours=1), 3_600)
    bad = F.col("level").isin("ERROR", "CRITICAL")
    hourly = materialize(
        telemetry(spark, sf_dir).groupBy("service", F.window("time", "1 hour")["start"].alias("tick")).agg(
            F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.max("latency_ms").alias("worst")
        )
    )
    services = hourly.groupBy().agg(F.collect_set("service").alias("s"))  # one name per service
    every = ticks.withColumn("service", F.explode(services.scalar()))
    rows = every.join(hourly, ["service", "tick"], "left").na.fill(0)
    rule = lambda name, holds: F.struct(F.lit(name).alias("alertname"), holds.alias("holds"))
    rules = F.array(
        rule("ServiceDown", F.col("n") == 0), rule("HighErrorRate", F.col("bad") > F.col("n") * 0.2), rule("HighLatency", F.col("worst") > 100)
    )
    return rows.select("service", "tick", F.inline(rules))


@query(
    "alert_pipeline",
    sql(
        f"SELECT alertname, service, severity, {ts('time')} AS time FROM (SELECT alertname, service, severity, time FROM k1 UNION ALL "
        "SELECT alertname, service, severity, time FROM k2)",
        "tel", "tl", extra=_EVALUATIONS, recursive=True,
    ),
)
def alert_pipeline(spark, sf_dir):
    """Evaluation, hold time, inhibition by a critical alert that fires, and repeat interval in turn."""
    return alerts.alert_pipeline(_evaluations(spark, sf_dir), _RULES, 3_600).select("alertname", "service", "severity", "time")


@query(
    "alert_inhibition",
    sql(
        f"SELECT service, severity, {ts('time')} AS time, anomaly_id FROM alr a WHERE severity <> 'warning' OR NOT EXISTS (SELECT 1 FROM alr c WHERE "
        "c.service = a.service AND c.severity = 'critical' AND a.time >= c.time AND a.time < c.time + INTERVAL 90 MINUTE)",
        "alr",
    ),
)
def alert_inhibition(spark, sf_dir):
    """A critical alert mutes warnings of its service for 90 minutes from its own time on, and none before."""
    rows = rule_alerts(spark, sf_dir)
    spans = rows.select("service", "severity", F.col("time").alias("starts_at"), (F.col("time") + F.expr("INTERVAL 90 MINUTES")).alias("ends_at"))
    return alerts.inhibit(rows, spans).dropDuplicates(["anomaly_id", "severity"]).select("service", "severity", "time", "anomaly_id")


@query(
    "alert_rules",
    sql(
        "SELECT 'FeatureDriftMajor' AS rule, feature AS subject, "
        f"{r6('psi')} AS value FROM (SELECT feature, sum((cur_share - ref_share) * ln(cur_share / ref_share)) AS psi FROM pb GROUP BY 1) WHERE psi > 0.25 "
        f"UNION ALL SELECT 'StaleModel', service, {r6('(epoch_us(t) - epoch_us(trained)) / 86400e6')} FROM (SELECT service, min(time) - INTERVAL 1 DAY AS trained "
        "FROM tel GROUP BY 1), latest WHERE (epoch_us(t) - epoch_us(trained)) / 86400e6 > 30",
        "feat", "tl", "tel", "latest", extra=_DRIFT,
    ),
)
def alert_rules(spark, sf_dir):
    drifted = alerts.drift_alerts(drift.psi(*_two_halves(spark, sf_dir))).select(
        F.lit("FeatureDriftMajor").alias("rule"), F.col("feature").alias("subject"), "value"
    )
    models = raw_telemetry(spark, sf_dir).groupBy("service").agg((F.min("time") - F.expr("INTERVAL 1 DAY")).alias("training_date"))
    stale = alerts.model_age(models, as_of(spark, sf_dir)).where("stale")
    return drifted.unionByName(stale.select(F.lit("StaleModel").alias("rule"), F.col("service").alias("subject"), F.col("age_days").alias("value")))


@query(
    "rate_alerts",
    sql(
        f"SELECT {ts('bucket')} AS bucket, service, n, {r6('rate')} AS rate, rate > 0.003::DOUBLE AS holds FROM (SELECT *, "
        "sum(n) OVER (PARTITION BY service ORDER BY bucket RANGE BETWEEN INTERVAL 599 SECOND PRECEDING AND CURRENT ROW) / 600.0::DOUBLE AS rate FROM "
        f"(SELECT time_bucket(INTERVAL 1 MINUTE, time) AS bucket, service, count(*) AS n FROM tel WHERE {ERR} GROUP BY 1, 2))",
        "tel",
    ),
)
def rate_alerts(spark, sf_dir):
    errors = raw_telemetry(spark, sf_dir).where(F.col("level").isin("ERROR", "CRITICAL"))
    return alerts.rate_alert(rollups.counts_per_bucket(errors, "1 minute", ["service"]), ["service"], 600, 0.003)


@query(
    "anomaly_rate_alert",
    sql(
        f"SELECT {ts('bucket')} AS bucket, n, {r6('rate')} AS rate, rate > 0.001::DOUBLE AS holds FROM (SELECT *, "
        "sum(n) OVER (ORDER BY bucket RANGE BETWEEN INTERVAL 599 SECOND PRECEDING AND CURRENT ROW) / 600.0::DOUBLE AS rate FROM "
        "(SELECT time_bucket(INTERVAL 1 MINUTE, time) AS bucket, count(*) AS n FROM anom GROUP BY 1))",
        "anom",
    ),
)
def anomaly_rate_alert(spark, sf_dir):
    """Anomalies a second over ten minutes, all services together."""
    counted = rollups.counts_per_bucket(anomalies(spark, sf_dir).withColumn("scope", F.lit("all")), "1 minute", ["scope"])
    return alerts.rate_alert(counted, ["scope"], 600, 0.001).drop("scope")


@query(
    "report_error_alert",
    sql(
        f"SELECT {ts('bucket')} AS bucket, n, {r6('rate')} AS rate, rate > 0.002::DOUBLE AS holds FROM (SELECT *, "
        "sum(n) OVER (ORDER BY bucket RANGE BETWEEN INTERVAL 299 SECOND PRECEDING AND CURRENT ROW) / 300.0::DOUBLE AS rate FROM "
        "(SELECT time_bucket(INTERVAL 1 MINUTE, generated_at) AS bucket, count(*) AS n FROM reps WHERE (epoch_us(generated_at) // 60000000) % 4 >= 2 GROUP BY 1))",
        "reps",
    ),
)
def report_error_alert(spark, sf_dir):
    """Reports whose response holds no complete report, a second, over five minutes."""
    parsed = reports.parse_responses(response_rows(spark, sf_dir))
    failed = parsed.where(~F.col("parsed_ok")).select(F.to_timestamp("detected_at").alias("time"), F.lit("all").alias("scope"))
    return alerts.rate_alert(rollups.counts_per_bucket(failed, "1 minute", ["scope"]), ["scope"], 300, 0.002).drop("scope")


@query(
    "cost_alert",
    sql(
        f"SELECT {ts('k.tick')} AS tick, {r6('coalesce(sum(h.cost), 0)')} AS cost_1d, coalesce(sum(h.cost), 0) > 0.02::DOUBLE AS holds FROM "
        "(SELECT unnest(generate_series((SELECT min(tick) FROM hc), t, INTERVAL 1 HOUR)) AS tick FROM latest) k LEFT JOIN hc h ON h.tick <= k.tick AND "
        "h.tick > k.tick - INTERVAL 24 HOUR GROUP BY k.tick",
        "reps", "latest",
        extra="hc AS (SELECT CAST(date_trunc('hour', generated_at) AS TIMESTAMP) AS tick, sum(cost_usd) AS cost FROM reps GROUP BY 1)",
    ),
)
def cost_alert(spark, sf_dir):
    return alerts.cost_alert(report_rows(spark, sf_dir), as_of(spark, sf_dir), limit=0.02)


@query(
    "explained_ratio",
    sql(
        f"SELECT {ts('b')} AS bucket, count(*) AS flagged, count(*) FILTER (severity <> 'MEDIUM') AS explained, "
        f"{r6('''CAST(count(*) FILTER (severity <> 'MEDIUM') AS DOUBLE) / count(*)''')} AS ratio FROM "
        "(SELECT time_bucket(INTERVAL 1 HOUR, time) AS b, severity FROM anom) GROUP BY b",
        "anom",
    ),
)
def explained_ratio(spark, sf_dir):
    """Medium anomalies stand for the ones whose attribution failed."""
    rows = anomalies(spark, sf_dir).withColumn("features", F.when(F.col("severity") != "MEDIUM", F.col("features")))
    return alerts.explained_ratio(rows)


@query(
    "latency_alerts",
    sql(
        f"SELECT service, {ts('tick')} AS tick, {r6('quantile_cont(latency_ms, 0.99)')} AS value, quantile_cont(latency_ms, 0.99) > 150 AS holds FROM "
        "(SELECT service, latency_ms, unnest(generate_series(time_bucket(INTERVAL 1 HOUR, time) + INTERVAL 1 HOUR, "
        "time_bucket(INTERVAL 1 HOUR, time) + INTERVAL 6 HOUR, INTERVAL 1 HOUR)) AS tick FROM tel WHERE latency_ms IS NOT NULL) x GROUP BY service, x.tick",
        "tel",
    ),
)
def latency_alerts(spark, sf_dir):
    """p99 latency of the trailing six hours at every full hour."""
    return alerts.latency_alert(telemetry(spark, sf_dir), "latency_ms", 0.99, 150.0, 21_600, 3_600, ["service"])


def _tail_sql(value: str, source: str, time: str, quantile: float, limit: float, keys: str = "") -> str:
    """Exact quantile of the trailing six hours at every full hour."""
    more = f", {keys}" if keys else ""
    return (
        f"SELECT {ts('tick')} AS tick{more}, {r6(f'quantile_cont(v, {quantile})')} AS value, quantile_cont(v, {quantile}) > {limit} AS holds FROM "
        f"(SELECT {value} AS v{more}, unnest(generate_series(time_bucket(INTERVAL 1 HOUR, {time}) + INTERVAL 1 HOUR, "
        f"time_bucket(INTERVAL 1 HOUR, {time}) + INTERVAL 6 HOUR, INTERVAL 1 HOUR)) AS tick FROM {source}) x GROUP BY x.tick{more}"
    )


@query("ingest_delay_alerts", sql(_tail_sql("(epoch_us(ingested_at) - epoch_us(time)) / 1000.0::DOUBLE", "tel", "time", 0.99, 45.503, "service"), "tel"))
def ingest_delay_alerts(spark, sf_dir):
    """p99 of the milliseconds between an event and its ingestion, per service; whole delays make it a multiple of 0.01."""
    delay = (F.unix_micros("ingested_at") - F.unix_micros("time")) / F.lit(1000.0)
    rows = raw_telemetry(spark, sf_dir).select("service", "time", delay.alias("delay_ms"))
    return alerts.latency_alert(rows, "delay_ms", 0.99, 45.503, 21_600, 3_600, ["service"])


@query("inference_time_alerts", sql(_tail_sql("generation_time_ms", "reps", "generated_at", 0.95, 1020), "reps"))
def inference_time_alerts(spark, sf_dir):
    """p95 of the time that a result took, over the trailing six hours."""
    rows = report_rows(spark, sf_dir).withColumn("time", F.col("generated_at"))
    return alerts.latency_alert(rows, "generation_time_ms", 0.95, 1020.0, 21_600, 3_600)


@query(
    "score_shift",
    sql(
        f"SELECT {ts('tick')} AS tick, {r6('s')} AS short_median, {r6('l')} AS long_median, {r6('abs(s - l) / abs(l + 1e-9::DOUBLE)')} AS change, "
        "coalesce(abs(s - l) / abs(l + 1e-9::DOUBLE) > 0.5, false) AS holds FROM (SELECT k.tick, quantile_cont(a.score, 0.5) FILTER (a.h > k.tick - INTERVAL 6 HOUR) AS s, "
        "quantile_cont(a.score, 0.5) AS l FROM (SELECT unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS tick FROM ah) k LEFT JOIN ah a "
        "ON a.h <= k.tick AND a.h > k.tick - INTERVAL 24 HOUR GROUP BY 1)",
        "anom", extra="ah AS (SELECT CAST(date_trunc('hour', time) AS TIMESTAMP) AS h, -er AS score FROM anom)",
    ),
)
def score_shift(spark, sf_dir):
    rows = anomalies(spark, sf_dir).withColumn("score", -F.element_at("features.values", "error_rate"))
    return alerts.score_shift(rows, short_h=6)
