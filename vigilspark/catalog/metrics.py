"""Queries over grouped metrics and joins (families A, J, W lists, R context)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilspark.catalog.base import (
    THRESHOLD, anomalies, as_of, fixed, labelled_series, query, r6, raw_telemetry, report_rows, rule_alerts, scenarios, scored,
    series, sql, stream_spans, table, telemetry, ts, usage,
)
from vigilspark.operators import alerts, attribution, evaluation, listing, reports, rollups, windows
from vigilspark.operators import series as series_ops
from vigilspark.schema import INCIDENT_REPORT, SEVERITIES
from vigilspark.session import materialize

ERR = "level IN ('ERROR', 'CRITICAL')"


def _rollup_body(width: str) -> str:
    return (
        f"SELECT time_bucket(INTERVAL {width}, time) AS bucket, service, count(*) AS event_count, avg(latency_ms) AS avg_latency, "
        "quantile_cont(latency_ms, 0.95) AS p95_latency, quantile_cont(latency_ms, 0.99) AS p99_latency, "
        "stddev_samp(latency_ms) AS latency_stddev, CAST(count(*) FILTER (level = 'ERROR') AS DOUBLE) / count(*) AS error_rate, "
        "CAST(count(*) FILTER (level = 'CRITICAL') AS DOUBLE) / count(*) AS critical_rate, "
        "count(DISTINCT endpoint) AS unique_endpoints FROM tel WHERE has_latency GROUP BY 1, 2"
    )


def _rollup_sql(width: str) -> str:
    return sql(
        f"SELECT {ts('bucket')} AS bucket, service, event_count, {r6('avg_latency')} AS avg_latency, {r6('p95_latency')} AS p95_latency, "
        f"{r6('p99_latency')} AS p99_latency, {r6('latency_stddev')} AS latency_stddev, {r6('error_rate')} AS error_rate, "
        f"{r6('critical_rate')} AS critical_rate, unique_endpoints FROM ({_rollup_body(width)})",
        "tel",
    )


def _rollup(width: str):
    return lambda spark, sf_dir: rollups.rollup(telemetry(spark, sf_dir), width)


for _name, _spark, _duck in (
    ("rollup_1m", "1 minute", "1 MINUTE"),
    ("rollup_5m", "5 minutes", "5 MINUTE"),
    ("rollup_1h", "1 hour", "1 HOUR"),
):
    query(_name, _rollup_sql(_duck))(_rollup(_spark))


@query(
    "export_metrics_5m",
    sql(
        f"SELECT {ts('w')} AS window, service, count(*) AS event_count, "
        f"{r6('''CAST(count(*) FILTER (level = 'ERROR') AS DOUBLE) / count(*)''')} AS error_rate, "
        f"{r6('quantile_cont(latency_ms, 0.5)')} AS p50_latency_ms, {r6('quantile_cont(latency_ms, 0.95)')} AS p95_latency_ms, "
        f"{r6('quantile_cont(latency_ms, 0.99)')} AS p99_latency_ms "
        "FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, time) AS w FROM tel, latest WHERE time > t - INTERVAL 7 DAY) GROUP BY w, service",
        "tel", "latest",
    ),
)
def export_metrics(spark, sf_dir):
    return rollups.export_metrics(telemetry(spark, sf_dir), as_of(spark, sf_dir))


@query(
    "anomaly_summary",
    sql(
        f"SELECT service, severity, count(*) AS total_anomalies, {r6('avg(score)')} AS avg_score, {ts('min(time)')} AS first_occurrence, "
        f"{ts('max(time)')} AS last_occurrence, count(*) FILTER (is_resolved) AS resolved_count, count(*) FILTER (NOT is_resolved) "
        "AS open_count FROM anom, latest WHERE time > t - INTERVAL 7 DAY GROUP BY 1, 2",
        "anom", "latest",
    ),
)
def anomaly_summary(spark, sf_dir):
    return rollups.anomaly_summary(anomalies(spark, sf_dir), as_of(spark, sf_dir))


@query(
    "open_anomalies",
    sql(
        "SELECT service, count(*) AS active_anomalies FROM anom, latest WHERE time >= t - INTERVAL 24 HOUR AND NOT is_resolved GROUP BY 1",
        "anom", "latest",
    ),
)
def open_anomalies(spark, sf_dir):
    return rollups.open_anomalies(anomalies(spark, sf_dir), as_of(spark, sf_dir))


@query(
    "service_health",
    sql(
        "SELECT service, event_count, "
        f"{r6('error_rate')} AS error_rate, {r6('coalesce(avg_latency, 0)')} AS avg_latency, coalesce(active_anomalies, 0) AS active_anomalies, "
        "CASE WHEN error_rate > 0.1 OR coalesce(active_anomalies, 0) > 5 THEN 'critical' "
        "WHEN error_rate > 0.05 OR coalesce(active_anomalies, 0) > 2 THEN 'degraded' ELSE 'healthy' END AS status FROM "
        f"(SELECT service, count(*) AS event_count, CAST(count(*) FILTER ({ERR}) AS DOUBLE) / count(*) AS error_rate, "
        "avg(latency_ms) AS avg_latency FROM tel, latest WHERE time >= t - INTERVAL 240 MINUTE GROUP BY 1) LEFT JOIN "
        "(SELECT service, count(*) AS active_anomalies FROM anom, latest WHERE time >= t - INTERVAL 24 HOUR AND NOT is_resolved GROUP BY 1) "
        "USING (service)",
        "tel", "anom", "latest",
    ),
)
def service_health(spark, sf_dir):
    """Over the last four hours: the sparse test table has few events in five minutes."""
    return rollups.service_health(telemetry(spark, sf_dir), anomalies(spark, sf_dir), as_of(spark, sf_dir), minutes=240)


@query(
    "events_by_service",
    sql(
        f"SELECT service, count(*) AS event_count, count(*) FILTER ({ERR}) AS errors, "
        f"{r6('round(avg((epoch_us(ingested_at) - epoch_us(time)) / 1000.0::DOUBLE), 2)')} AS avg_delay_ms "
        "FROM tel, latest WHERE time > t - INTERVAL 24 HOUR GROUP BY 1",
        "tel", "latest",
    ),
)
def events_by_service(spark, sf_dir):
    return rollups.events_by_service(raw_telemetry(spark, sf_dir), as_of(spark, sf_dir), hours=24)


@query("events_by_level", sql("SELECT level, count(*) AS n FROM tel GROUP BY 1", "tel"))
def events_by_level(spark, sf_dir):
    return rollups.counts_by(raw_telemetry(spark, sf_dir), "level")


@query(
    "report_totals",
    sql(
        f"SELECT count(*) AS reports_generated, {r6('round(coalesce(sum(cost_usd), 0), 4)')} AS total_cost, "
        "CAST(coalesce(sum(tokens_used), 0) AS BIGINT) AS total_tokens FROM reps, latest WHERE generated_at > t - INTERVAL 240 HOUR",
        "reps", "latest",
    ),
)
def report_totals(spark, sf_dir):
    return rollups.report_totals(report_rows(spark, sf_dir), as_of(spark, sf_dir), hours=240)


@query(
    "top_feature_counts",
    sql(
        "SELECT feature, count(*) AS n FROM attr, latest WHERE rank = 1 AND time > t - INTERVAL 240 HOUR GROUP BY 1",
        "attr", "latest",
    ),
)
def top_feature_counts(spark, sf_dir):
    return rollups.top_feature_counts(anomalies(spark, sf_dir), as_of(spark, sf_dir), hours=240)


@query(
    "request_log_summary",
    sql(
        "SELECT total, ok, failed, "
        f"{r6('avg_latency')} AS avg_latency, {r6('p50')} AS p50_latency, {r6('p95')} AS p95_latency, {r6('p99')} AS p99_latency, "
        f"{r6('100.0::DOUBLE * ok / total')} AS success_rate, {r6('total / 2592000.0::DOUBLE')} AS rate, "
        "total / 2592000.0::DOUBLE >= 50000 * 0.95 AS rate_ok, p99 <= 150 AS p99_ok, 100.0::DOUBLE * ok / total >= 99.9 AS success_ok FROM "
        "(SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS failed, "
        "avg(value) AS avg_latency, median(value) AS p50, "
        "list_extract(list_sort(list(value)), CAST(floor(count(*) * 0.95::DOUBLE) AS BIGINT) + 1) AS p95, "
        "list_extract(list_sort(list(value)), CAST(floor(count(*) * 0.99::DOUBLE) AS BIGINT) + 1) AS p99 FROM events)"
    ),
)
def request_log_summary(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), F.col("value").alias("elapsed"), (F.col("event_type") != "error").alias("success")
    )
    return rollups.request_log_summary(log, duration_seconds=30 * 86_400)


@query(
    "ingest_delay_1m",
    sql(
        f"SELECT {ts('time_bucket(INTERVAL 1 MINUTE, time)')} AS bucket, "
        f"{r6('avg((epoch_us(ingested_at) - epoch_us(time)) / 1000.0::DOUBLE)')} AS avg_delay_ms FROM tel GROUP BY 1",
        "tel",
    ),
)
def ingest_delay(spark, sf_dir):
    return rollups.ingest_delay_per_bucket(raw_telemetry(spark, sf_dir))


@query(
    "event_rate_1m",
    sql(
        f"SELECT {ts('b')} AS bucket, service, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 MINUTE, time) AS b, service FROM tel) "
        "GROUP BY b, service",
        "tel",
    ),
)
def event_rate(spark, sf_dir):
    return rollups.counts_per_bucket(raw_telemetry(spark, sf_dir), "1 minute", ["service"])


@query(
    "event_rate_1m_total",
    sql(
        f"SELECT {ts('b')} AS bucket, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 MINUTE, time) AS b FROM tel) GROUP BY b", "tel"
    ),
)
def event_rate_total(spark, sf_dir):
    return rollups.counts_per_bucket(raw_telemetry(spark, sf_dir), "1 minute")


@query(
    "anomalies_1h",
    sql(
        f"SELECT {ts('b')} AS bucket, severity, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, time) AS b, severity FROM anom) "
        "GROUP BY b, severity",
        "anom",
    ),
)
def anomalies_per_hour(spark, sf_dir):
    return rollups.counts_per_bucket(anomalies(spark, sf_dir), "1 hour", ["severity"])


_BOUNDS = (5.0, 10.0, 25.0, 50.0, 100.0, 250.0)


@query(
    "histogram_quantile",
    sql(
        "SELECT service, q, "
        + r6(
            "CASE WHEN slot = 6 THEN 250.0 ELSE lo + (hi - lo) * (q * total - (upto - n)) / n END"
        )
        + " AS value FROM (SELECT *, CASE WHEN slot = 0 THEN 0.0::DOUBLE ELSE list_extract(bounds, slot) END AS lo, "
        "list_extract(bounds, least(slot, 5) + 1) AS hi FROM (SELECT service, slot, n, "
        "[5.0::DOUBLE, 10, 25, 50, 100, 250] AS bounds, sum(n) OVER (PARTITION BY service ORDER BY slot) AS upto, "
        "sum(n) OVER (PARTITION BY service) AS total FROM (SELECT service, CAST(len(list_filter([5.0::DOUBLE, 10, 25, 50, 100, 250], "
        "lambda b: b < latency_ms)) AS INT) AS slot, count(*) AS n FROM tel WHERE latency_ms IS NOT NULL GROUP BY 1, 2))), "
        "(SELECT unnest([0.5::DOUBLE, 0.95, 0.99]) AS q) WHERE upto >= q * total AND upto - n < q * total",
        "tel",
    ),
)
def histogram_quantile(spark, sf_dir):
    return rollups.histogram_quantiles(telemetry(spark, sf_dir), "latency_ms", _BOUNDS, (0.5, 0.95, 0.99), ["service"])


@query(
    "error_rate_trailing",
    sql(
        f"SELECT {r6(f'100.0::DOUBLE * count(*) FILTER (time > t - INTERVAL 5 MINUTE AND {ERR}) / count(*) FILTER (time > t - INTERVAL 5 MINUTE)')} "
        "AS error_rate_pct, count(*) AS events_last_hour FROM tel, latest WHERE time > t - INTERVAL 1 HOUR",
        "tel", "latest",
    ),
)
def error_rate_trailing(spark, sf_dir):
    return rollups.error_rate_trailing(raw_telemetry(spark, sf_dir), as_of(spark, sf_dir))


@query(
    "rate_gauges",
    sql(
        f"SELECT {ts('bucket')} AS bucket, service, n, {r6('n / 60.0')} AS rate_1m, "
        f"{r6('sum(n) OVER (PARTITION BY service ORDER BY bucket RANGE BETWEEN INTERVAL 299 SECOND PRECEDING AND CURRENT ROW) / 300.0')} AS rate_5m, "
        f"{r6('sum(n) OVER (PARTITION BY service ORDER BY bucket RANGE BETWEEN INTERVAL 3599 SECOND PRECEDING AND CURRENT ROW) / 3600.0')} AS rate_1h, "
        "CAST(sum(n) OVER (PARTITION BY service ORDER BY bucket) AS BIGINT) AS running_total FROM "
        "(SELECT time_bucket(INTERVAL 1 MINUTE, time) AS bucket, service, count(*) AS n FROM tel GROUP BY 1, 2)",
        "tel",
    ),
)
def rate_gauges(spark, sf_dir):
    counts = rollups.counts_per_bucket(raw_telemetry(spark, sf_dir), "1 minute", ["service"])
    return rollups.trailing_rates(counts, ["service"], {"rate_1m": 60, "rate_5m": 300, "rate_1h": 3600})


_SCORE_BOUNDS = (-0.9, -0.6, -0.45, -0.3, -0.25, -0.2)
_SCORE_LIST = "[" + ", ".join(f"{b}::DOUBLE" for b in _SCORE_BOUNDS) + "]"
_SLOT = f"CAST(len(list_filter({_SCORE_LIST}, lambda b: b < score)) AS INT)"


def _trailing_sum(keys: str, seconds: int) -> str:
    return f"sum(n) OVER (PARTITION BY {keys} ORDER BY bucket RANGE BETWEEN INTERVAL {seconds - 1} SECOND PRECEDING AND CURRENT ROW)"


@query(
    "score_quantile",
    sql(
        "SELECT severity, q, " + r6("CASE WHEN slot = 6 THEN -0.2 ELSE lo + (hi - lo) * (q * total - (upto - n)) / n END")
        + " AS value FROM (SELECT *, CASE WHEN slot = 0 THEN least(0.0, hi) ELSE list_extract(bounds, slot) END AS lo FROM (SELECT severity, slot, n, bounds, "
        "list_extract(bounds, least(slot, 5) + 1) AS hi, sum(n) OVER (PARTITION BY severity ORDER BY slot) AS upto, sum(n) OVER (PARTITION BY severity) AS total "
        f"FROM (SELECT severity, {_SLOT} AS slot, count(*) AS n, {_SCORE_LIST} AS bounds FROM anom GROUP BY 1, 2))), "
        "(SELECT unnest([0.5::DOUBLE, 0.9]) AS q) WHERE upto >= q * total AND upto - n < q * total",
        "anom",
    ),
)
def score_quantile(spark, sf_dir):
    """Median and 90th percentile of the scores from buckets with negative bounds, per severity."""
    return rollups.histogram_quantiles(anomalies(spark, sf_dir), "score", _SCORE_BOUNDS, (0.5, 0.9), ["severity"])


@query(
    "detection_gauges",
    sql(
        f"SELECT kind, {ts('bucket')} AS bucket, n, {r6('60 * ' + _trailing_sum('kind', 300) + ' / 300.0')} AS per_min_5m, "
        f"{r6('60 * ' + _trailing_sum('kind', 3600) + ' / 3600.0')} AS per_min_1h, "
        "CAST(sum(n) OVER (PARTITION BY kind ORDER BY bucket) AS BIGINT) AS running_total FROM (SELECT kind, time_bucket(INTERVAL 1 MINUTE, time) AS bucket, "
        "count(*) AS n FROM (SELECT 'anomaly' AS kind, time FROM anom UNION ALL SELECT 'prediction', window_end FROM scored) GROUP BY 1, 2)",
        "anom", "scored",
    ),
)
def detection_gauges(spark, sf_dir):
    """Predictions and anomalies a minute over trailing five minutes and an hour, and their totals."""
    found = anomalies(spark, sf_dir).select(F.lit("anomaly").alias("kind"), "time")
    made = scored(spark, sf_dir).select(F.lit("prediction").alias("kind"), F.col("window_end").alias("time"))
    counts = rollups.counts_per_bucket(found.unionByName(made), "1 minute", ["kind"])
    rates = rollups.trailing_rates(counts, ["kind"], {"per_min_5m": 300, "per_min_1h": 3600})
    per_minute = {c: F.col(c) * 60 for c in ("per_min_5m", "per_min_1h")}
    return rates.withColumns(per_minute).select("kind", "bucket", "n", "per_min_5m", "per_min_1h", "running_total")


@query(
    "score_buckets",
    sql(
        f"SELECT slot, {ts('bucket')} AS bucket, n, {r6(_trailing_sum('slot', 86_400) + ' / 86400.0')} AS rate_1d FROM "
        f"(SELECT {_SLOT} AS slot, time_bucket(INTERVAL 1 MINUTE, time) AS bucket, count(*) AS n FROM anom GROUP BY 1, 2)",
        "anom",
    ),
)
def score_buckets(spark, sf_dir):
    """Anomalies a second over a trailing day in each score bucket."""
    edges = F.array(*[F.lit(b) for b in _SCORE_BOUNDS])
    rows = anomalies(spark, sf_dir).select("time", F.size(F.filter(edges, lambda b: b < F.col("score"))).alias("slot"))
    counts = rollups.counts_per_bucket(rows, "1 minute", ["slot"])
    return rollups.trailing_rates(counts, ["slot"], {"rate_1d": 86_400}).select("slot", "bucket", "n", "rate_1d")


# -- joins ----------------------------------------------------------------------


@query(
    "recent_critical_anomalies",
    sql(
        f"SELECT {ts('a.time')} AS time, a.service, anomaly_id, {r6('a.score')} AS score, a.severity, {r6('confidence')} AS confidence, "
        "is_resolved, report_id, CAST(NULL AS VARCHAR) AS s3_location FROM anom a LEFT JOIN reps r USING (anomaly_id), latest "
        "WHERE a.severity IN ('HIGH', 'CRITICAL') AND a.time > t - INTERVAL 24 HOUR",
        "anom", "reps", "latest",
    ),
)
def recent_critical_anomalies(spark, sf_dir):
    return listing.recent_critical_anomalies(anomalies(spark, sf_dir), report_rows(spark, sf_dir), as_of(spark, sf_dir))


@query(
    "anomalies_without_report",
    sql(
        f"SELECT anomaly_id, service, severity, {ts('time')} AS time FROM anom a WHERE NOT EXISTS "
        "(SELECT 1 FROM reps r WHERE r.anomaly_id = a.anomaly_id) ORDER BY a.time, anomaly_id LIMIT 20",
        "anom", "reps",
    ),
)
def anomalies_without_report(spark, sf_dir):
    return listing.anomalies_without_report(anomalies(spark, sf_dir), report_rows(spark, sf_dir)).select(
        "anomaly_id", "service", "severity", "time"
    )


@query(
    "label_windows",
    sql(
        f"SELECT {ts('window_start')} AS window_start, {ts('window_end')} AS window_end, scenario_type, label FROM labels_w", "labels_w"
    ),
)
def label_windows(spark, sf_dir):
    from vigilspark.catalog.base import STRIDE_S, WINDOW_S, timeline

    start, end = timeline(spark, sf_dir)
    spine = windows.window_spine(spark, start, end, WINDOW_S, STRIDE_S)
    return windows.label_windows(spine, scenarios(spark, sf_dir))


@query("label_points", sql("SELECT stream, i, metric, label FROM serl", "serl"))
def label_points(spark, sf_dir):
    return series_ops.label_points(series(spark, sf_dir), stream_spans(spark, sf_dir)).select("stream", "i", "metric", "label")


_CONTEXT = (
    "ctx AS (SELECT * FROM (SELECT a.anomaly_id, e.event_id, e.time, e.service, e.level, e.message, "
    "row_number() OVER (PARTITION BY a.anomaly_id ORDER BY e.time DESC, e.event_id DESC) AS age FROM anom a JOIN tel e "
    "ON e.service = a.service AND e.time BETWEEN a.time - INTERVAL 10 MINUTE AND a.time + INTERVAL 10 MINUTE) WHERE age <= 100)"
)


@query(
    "context_events",
    sql(f"SELECT anomaly_id, event_id, {ts('time')} AS time, service, level, message FROM ctx", "anom", "tel", extra=_CONTEXT),
)
def context_events(spark, sf_dir):
    near = windows.context_events(anomalies(spark, sf_dir), raw_telemetry(spark, sf_dir))
    return near.select("anomaly_id", "event_id", "time", "service", "level", "message")


_METRICS = (
    f"m5 AS ({_rollup_body('5 MINUTE')}), ctm AS (SELECT a.anomaly_id, a.service, avg(m.event_count) AS avg_event_count, "
    "avg(m.error_rate) AS avg_error_rate, avg(m.avg_latency) AS avg_latency, avg(m.p95_latency) AS avg_p95_latency, "
    "avg(m.p99_latency) AS avg_p99_latency FROM anom a LEFT JOIN m5 m ON m.service = a.service AND m.bucket BETWEEN "
    "a.time - INTERVAL 10 MINUTE AND a.time + INTERVAL 10 MINUTE GROUP BY 1, 2)"
)
_MEANS = ("avg_event_count", "avg_error_rate", "avg_latency", "avg_p95_latency", "avg_p99_latency")


@query(
    "context_metrics",
    sql(
        f"SELECT anomaly_id, service, {', '.join(f'{r6(m)} AS {m}' for m in _MEANS)} FROM ctm", "anom", "tel", extra=_METRICS
    ),
)
def context_metrics(spark, sf_dir):
    return windows.context_metrics(anomalies(spark, sf_dir), rollups.rollup(telemetry(spark, sf_dir), "5 minutes"))


@query(
    "scenario_detection",
    sql(
        f"SELECT scenario_id, type, {ts('start_ts')} AS start_ts, {ts('end_ts')} AS end_ts, "
        f"{r6('(epoch_us(end_ts) - epoch_us(start_ts)) / 1e6')} AS duration_s, windows_total, windows_caught, "
        f"{r6('(epoch_us(first) - epoch_us(start_ts)) / 1e6')} AS detection_latency_s FROM det",
        "scen", "scored",
        extra="det AS (SELECT c.scenario_id, c.type, c.start_ts, c.end_ts, count(s.score) AS windows_total, "
        f"count(*) FILTER (s.score < {THRESHOLD}) AS windows_caught, min(s.window_start) FILTER (s.score < {THRESHOLD}) AS first "
        "FROM scen c LEFT JOIN scored s ON c.start_ts < s.window_end AND c.end_ts > s.window_start GROUP BY ALL)",
    ),
)
def scenario_detection(spark, sf_dir):
    return evaluation.scenario_detection(scenarios(spark, sf_dir), scored(spark, sf_dir), THRESHOLD)


@query(
    "series_label_join",
    sql(
        f"SELECT stream, i, metric, {r6('value')} AS value, label FROM serl "
        "JOIN (SELECT stream AS st, max(i) AS last_i FROM serl GROUP BY 1) ON stream = st WHERE i < last_i OR CAST(stream AS INT) % 2 = 1",
        "serl",
    ),
)
def series_label_join(spark, sf_dir):
    """Every second label vector is one point short of its series; the join cuts the series to it."""
    full = labelled_series(spark, sf_dir)
    labels = full.where("metric = 0").select("stream", "i", "label")
    last = labels.groupBy("stream").agg(F.max("i").alias("last_i"))
    vector = labels.join(last, "stream").where("i < last_i OR CAST(stream AS INT) % 2 = 1").drop("last_i")
    return series_ops.join_labels(full, vector).select("stream", "i", "metric", "value", "label")


@query(
    "top_features_values",
    sql(
        f"SELECT anomaly_id, CAST(rank AS INT) AS rank, feature, {r6('value')} AS value, {r6('shap')} AS shap, "
        "CASE WHEN shap < 0 THEN 'toward_anomaly' ELSE 'toward_normal' END AS direction FROM attr",
        "attr",
    ),
)
def top_features_values(spark, sf_dir):
    return anomalies(spark, sf_dir).select("anomaly_id", "features.values", F.posexplode("features.top_features").alias("at", "f")).select(
        "anomaly_id",
        (F.col("at") + 1).alias("rank"),
        F.col("f.name").alias("feature"),
        F.element_at("values", F.col("f.name")).alias("value"),
        F.col("f.shap").alias("shap"),
        F.col("f.direction").alias("direction"),
    )


@query(
    "inhibit_alerts",
    sql(
        "SELECT anomaly_id, service, severity FROM (SELECT *, CAST(time AS DATE) AS d FROM alr) x WHERE severity = 'critical' OR NOT EXISTS "
        "(SELECT 1 FROM alr c WHERE c.severity = 'critical' AND c.service = x.service AND CAST(c.time AS DATE) = x.d)",
        "alr",
    ),
)
def inhibit_alerts(spark, sf_dir):
    """A critical alert counts as firing all of its day; ``alert_inhibition`` takes spans from its own time on."""
    rows = rule_alerts(spark, sf_dir)
    day = F.date_trunc("day", "time")
    spans = rows.select("service", "severity", day.alias("starts_at"), (day + F.expr("INTERVAL 1 DAY")).alias("ends_at")).distinct()
    return alerts.inhibit(rows, spans).select("anomaly_id", "service", "severity")


@query(
    "report_cost",
    sql(
        "SELECT conv_id, model, input_tokens, output_tokens, p.input_per_m IS NULL AS price_is_default, "
        + r6(
            "round(input_tokens * (coalesce(p.input_per_m, 0.075) / 1e6) + output_tokens * (coalesce(p.output_per_m, 0.3) / 1e6), 6)"
        )
        + " AS cost_usd FROM usage LEFT JOIN prices p USING (model)",
        "usage", "prices",
    ),
)
def report_cost(spark, sf_dir):
    return reports.report_cost(usage(spark, sf_dir))


@query(
    "recent_anomalies_per_service",
    sql(
        f"SELECT service, CAST(rank AS INT) AS rank, {ts('time')} AS time, severity, {r6('score')} AS score FROM "
        "(SELECT *, row_number() OVER (PARTITION BY service ORDER BY time DESC, anomaly_id) AS rank FROM anom) WHERE rank <= 5",
        "anom",
    ),
)
def recent_anomalies_per_service(spark, sf_dir):
    return listing.recent_anomalies_per_service(anomalies(spark, sf_dir)).select("service", "rank", "time", "severity", "score")


def _context(spark, sf_dir):
    return reports.report_context(
        materialize(anomalies(spark, sf_dir)), raw_telemetry(spark, sf_dir), rollups.rollup(telemetry(spark, sf_dir), "5 minutes")
    )


@query(
    "report_context",
    sql(
        "SELECT a.anomaly_id, a.service, a.severity, CAST(coalesce(c.n, 0) AS INT) AS context_events, "
        "CAST(coalesce(c.errs, 0) AS INT) AS error_events, c.newest AS newest_event, "
        f"{', '.join(f'{r6(m)} AS {m}' for m in _MEANS)}, CAST(r.n AS INT) AS n_recent, {r6('r.s')} AS recent_score_sum FROM anom a "
        f"LEFT JOIN (SELECT anomaly_id, count(*) AS n, count(*) FILTER ({ERR}) AS errs, min(event_id) FILTER (age = 1) AS newest "
        "FROM ctx GROUP BY 1) c USING (anomaly_id) JOIN ctm USING (anomaly_id) LEFT JOIN (SELECT service, count(*) AS n, sum(score) AS s "
        "FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY time DESC, anomaly_id) AS rank FROM anom) WHERE rank <= 5 GROUP BY 1) r "
        "ON r.service = a.service",
        "anom", "tel", extra=_CONTEXT + ", " + _METRICS,
    ),
)
def report_context(spark, sf_dir):
    return _context(spark, sf_dir).select(
        "anomaly_id", "service", "severity", "context_events", "error_events", F.get("events.event_id", F.lit(0)).alias("newest_event"),
        *_MEANS, F.size("recent_anomalies").alias("n_recent"),
        F.aggregate("recent_anomalies", F.lit(0.0), lambda s, x: s + x["score"]).alias("recent_score_sum"),
    )


@query(
    "report_fields",
    sql(
        f"SELECT a.anomaly_id, a.service, {ts('a.time')} AS detected_at, a.severity, {r6('a.score')} AS score, "
        f"{r6('coalesce(avg_error_rate, 0)')} AS error_rate, CAST(floor(coalesce(avg_event_count, 0)) AS BIGINT) AS total_events, "
        f"CAST(coalesce(c.errs, 0) AS INT) AS error_events, {r6('coalesce(avg_latency, 0)')} AS avg_latency, "
        f"{r6('coalesce(avg_p99_latency, 0)')} AS p99_latency FROM anom a JOIN ctm USING (anomaly_id) LEFT JOIN "
        f"(SELECT anomaly_id, count(*) FILTER ({ERR}) AS errs FROM ctx GROUP BY 1) c USING (anomaly_id)",
        "anom", "tel", extra=_CONTEXT + ", " + _METRICS,
    ),
)
def report_fields(spark, sf_dir):
    return reports.report_fields(_context(spark, sf_dir))


_FIELDS = (
    "fld AS (SELECT a.anomaly_id, a.service, a.time, a.severity, a.score, coalesce(avg_error_rate, 0) AS er2, "
    "CAST(floor(coalesce(avg_event_count, 0)) AS BIGINT) AS total, coalesce(c.errs, 0) AS errs, coalesce(avg_latency, 0) AS lat2, "
    f"coalesce(avg_p99_latency, 0) AS p99 FROM anom a JOIN ctm USING (anomaly_id) LEFT JOIN (SELECT anomaly_id, count(*) FILTER ({ERR}) AS errs "
    "FROM ctx GROUP BY 1) c USING (anomaly_id))"
)
_CLOCK = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@query(
    "render_report",
    sql(
        "SELECT anomaly_id, concat_ws(chr(10), '# Incident ' || anomaly_id, '**Service**: `' || service || '`, **severity**: ' || severity || "
        f"', **score**: ' || {fixed('score', 3)}, chr(10) || '## Summary', 'Unusual behaviour of ' || service || ' was detected at ' || {_CLOCK.format('time')} || '.', "
        f"chr(10) || '## Impact', '- error rate: ' || {fixed('er2 * 100', 2)} || '%', '- events per rollup bucket: ' || total || ', error events seen: ' || errs, "
        f"'- latency: mean ' || {fixed('lat2', 1)} || ' ms, p99 ' || {fixed('p99', 1)} || ' ms', chr(10) || '## Likely cause', "
        "CASE WHEN er2 > 0.05 THEN 'Errors are raised above their usual share.' ELSE 'No error surge; look at load and latency first.' END, "
        "CASE WHEN p99 > 2 * lat2 THEN 'The slowest requests take more than twice the mean.' END, chr(10) || '## Next steps', "
        "CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN '1. Page the owner of the service.' || chr(10) || '2. Roll back the last change.' "
        "ELSE '1. Watch the next windows.' || chr(10) || '2. Open a ticket.' END, '3. Compare with the recent anomalies of the service.') AS content FROM fld",
        "anom", "tel", extra=_CONTEXT + ", " + _METRICS + ", " + _FIELDS,
    ),
)
def render_report(spark, sf_dir):
    return reports.render_report(reports.report_fields(_context(spark, sf_dir))).select("anomaly_id", "content")


_EVIDENCE = (
    "tops AS (SELECT anomaly_id, string_agg('  - ' || feature || ': value=' || " + fixed("value", 3) + " || ', shap=' || " + fixed("shap", 3, "+")
    + " || ' (' || CASE WHEN shap < 0 THEN 'toward_anomaly' ELSE 'toward_normal' END || ')', chr(10) ORDER BY rank) AS t FROM attr WHERE rank <= 3 GROUP BY 1), "
    "evs AS (SELECT anomaly_id, string_agg(age || '. [' || " + _CLOCK.format("time") + " || '] ' || level || ' - ' || service || ': ' || "
    "CASE WHEN length(message) > 100 THEN substr(message, 1, 97) || '...' ELSE message END, chr(10) ORDER BY age) AS t FROM ctx WHERE age <= 10 GROUP BY 1), "
    "rec AS (SELECT service, string_agg(rank || '. [' || " + _CLOCK.format("time") + " || '] ' || severity || ' score ' || " + fixed("score", 3)
    + ", chr(10) ORDER BY rank) AS t FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY time DESC, anomaly_id) AS rank FROM anom) WHERE rank <= 5 GROUP BY 1), "
    "evi AS (SELECT a.anomaly_id, a.window_size, a.er, a.lat, 'Anomaly ' || a.anomaly_id || ' on ' || a.service || ' (' || a.severity || '), score ' || " + fixed("a.score", 3)
    + " || ', threshold ' || " + fixed("a.threshold", 3) + " AS head, tops.t AS tops, coalesce(evs.t, 'No events available') AS evs, coalesce(rec.t, 'none') AS rec, "
    "CASE WHEN avg_event_count IS NULL THEN 'No metrics available' ELSE concat_ws(chr(10), "
    + ", ".join(f"'- **{m.replace('_', ' ').title()}**: ' || {fixed(m, 2)}" for m in _MEANS)
    + ") END AS mets FROM anom a JOIN tops USING (anomaly_id) JOIN ctm USING (anomaly_id) LEFT JOIN evs USING (anomaly_id) LEFT JOIN rec ON rec.service = a.service)"
)
_PARTS = "chr(10) || chr(10)"


@query(
    "evidence_prompt",
    sql(
        f"SELECT anomaly_id, concat_ws({_PARTS}, head, 'Attributions:' || chr(10) || tops, 'Metrics:' || chr(10) || mets, 'Events:' || chr(10) || evs, "
        "'Recent anomalies:' || chr(10) || rec, 'Write an incident report in markdown: what happened, who is affected, the likely cause with its evidence, "
        "what to do now and later, and what to watch.') AS prompt FROM evi",
        "anom", "tel", "attr", extra=_CONTEXT + ", " + _METRICS + ", " + _EVIDENCE,
    ),
)
def evidence_prompt(spark, sf_dir):
    return reports.evidence_prompt(_context(spark, sf_dir))


@query(
    "structured_prompt",
    sql(
        f"SELECT anomaly_id, concat_ws({_PARTS}, 'Answer with one JSON object and nothing else.', '## Evidence' || chr(10) || head, "
        "'## Contributing features' || chr(10) || tops, '## Metrics' || chr(10) || mets, '## Events' || chr(10) || evs, "
        f"'## Fields' || chr(10) || '{', '.join(f.name for f in INCIDENT_REPORT.fields)}' || chr(10) || 'Severity is one of {', '.join(SEVERITIES)}; "
        "ground the hypothesis in the features listed.') AS prompt, window_size AS event_count FROM evi",
        "anom", "tel", "attr", extra=_CONTEXT + ", " + _METRICS + ", " + _EVIDENCE,
    ),
)
def structured_prompt(spark, sf_dir):
    """The JSON of the feature values is compared by one of its values; engines print doubles differently."""
    rows = reports.structured_prompt(_context(spark, sf_dir))
    values = F.regexp_extract("prompt", r"## Feature values\n(\{.*\})\n\n", 1)
    rest = F.regexp_replace("prompt", r"## Feature values\n\{.*\}\n\n", "")
    return rows.select("anomaly_id", rest.alias("prompt"), F.get_json_object(values, "$.event_count").cast("double").cast("bigint").alias("event_count"))
