"""Queries over records: validation, ingest, listings, lookups, JSON fields (families S, P, F, U)."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from vigilspark.catalog.base import (
    anomalies, as_of, fixed, query, r6, raw_json, raw_telemetry, report_rows, response_rows, scenarios, severity_sql, sql,
    table, telemetry, timeline, timeline_documents, ts,
)
from vigilspark.functions.scalars import iso_timestamp, with_metadata_fields
from vigilspark.operators import alerts, listing, reports, rollups, validation
from vigilspark.sources.readers import in_time_range, timeline_scenarios
from vigilspark.sources.writers import retention_split

ERR = "level IN ('ERROR', 'CRITICAL')"


@query(
    "scan_time_range",
    sql(
        f"SELECT event_id, {ts('time')} AS time, service, level, message, trace_id FROM tel, tl "
        "WHERE time >= s + INTERVAL 2 DAY AND time < s + INTERVAL 5 DAY",
        "tel", "tl",
    ),
)
def scan_time_range(spark, sf_dir):
    start, _ = timeline(spark, sf_dir)
    return (
        raw_telemetry(spark, sf_dir)
        .where(in_time_range("time", start + timedelta(days=2), start + timedelta(days=5)))
        .select("event_id", "time", "service", "level", "message", "trace_id")
    )


@query(
    "scenario_timeline",
    sql(
        f"SELECT {ts('week')} AS week, CAST(row_number() OVER (PARTITION BY week ORDER BY scenario_id) - 1 AS INT) AS scenario_no, "
        f"type, {ts('start_ts')} AS start_ts, {ts('end_ts')} AS end_ts "
        "FROM (SELECT *, CAST(date_trunc('week', start_ts) AS TIMESTAMP) AS week FROM scen)",
        "scen",
    ),
)
def scenario_timeline(spark, sf_dir):
    return timeline_scenarios(timeline_documents(spark, sf_dir))


@query(
    "retention_split",
    sql(
        "SELECT CAST(CAST(time AS DATE) AS VARCHAR) AS event_date, count(*) FILTER (time >= t - INTERVAL 10 DAY) AS kept, "
        "count(*) FILTER (time < t - INTERVAL 10 DAY) AS dropped FROM tel, latest GROUP BY 1",
        "tel", "latest",
    ),
)
def retention(spark, sf_dir):
    return retention_split(raw_telemetry(spark, sf_dir), as_of(spark, sf_dir), 10)


_STATUS = (
    "CASE WHEN event_id % 31 = 0 THEN 'unmarshal_error' WHEN event_id % 37 = 0 OR event_id % 43 = 0 "
    "THEN 'validation_error' ELSE 'accepted' END"
)


@query(
    "validate_events",
    sql(
        "SELECT event_id, status, array_to_string(CASE WHEN status = 'unmarshal_error' THEN ['unmarshal_error'] ELSE "
        "list_filter([CASE WHEN event_id % 43 = 0 THEN 'service_required' END, CASE WHEN event_id % 37 = 0 THEN 'level_invalid' END], "
        f"lambda x: x IS NOT NULL) END, ',') AS errors FROM (SELECT event_id, {_STATUS} AS status FROM tel)",
        "tel",
    ),
)
def validate_events(spark, sf_dir):
    parsed = validation.parse_json_events(raw_json(spark, sf_dir))
    return parsed.select("event_id", "status", F.array_join("errors", ",").alias("errors"))


@query("json_quarantine", sql(f"SELECT status, count(*) AS n FROM (SELECT {_STATUS} AS status FROM tel) GROUP BY 1", "tel"))
def json_quarantine(spark, sf_dir):
    return rollups.counts_by(validation.parse_json_events(raw_json(spark, sf_dir)), "status")


@query(
    "validate_batches",
    sql(
        "SELECT batch_id, CAST(count(*) FILTER (event_id % 11 <> 0) AS INT) AS n_events, "
        "CAST(count(*) FILTER (event_id % 11 <> 0 AND event_id % 37 = 0) AS INT) AS n_invalid, "
        "count(*) FILTER (event_id % 11 <> 0) BETWEEN 1 AND 20 AND count(*) FILTER (event_id % 11 <> 0 AND event_id % 37 = 0) = 0 "
        "AS batch_accepted FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN event_id // 11 + 1000000000 ELSE event_id // 25 END "
        "AS batch_id FROM tel) GROUP BY 1",
        "tel",
    ),
)
def validate_batches(spark, sf_dir):
    """Batches of up to 25 consecutive events against a limit of 20; every 11th event makes an empty batch."""
    i = F.col("event_id")
    level = F.when(i % 37 == 0, "TRACE").otherwise(F.col("level"))
    event = F.struct("time", "service", level.alias("level"), "message")
    batches = (
        raw_telemetry(spark, sf_dir)
        .withColumn("batch_id", F.when(i % 11 == 0, F.floor(i / 11) + 1_000_000_000).otherwise(F.floor(i / 25)))
        .groupBy("batch_id")
        .agg(F.collect_list(F.when(i % 11 != 0, event)).alias("events"))
    )
    return validation.validate_batches(batches, max_events=20).drop("events")


@query(
    "enrich_events",
    sql(
        f"SELECT event_id, {ts('CASE WHEN event_id % 19 = 0 THEN t ELSE time END')} AS time, {ts('t')} AS ingested_at, "
        "'worker-1' AS host FROM tel, latest",
        "tel", "latest",
    ),
)
def enrich_events(spark, sf_dir):
    events = raw_telemetry(spark, sf_dir).withColumn("time", F.when(F.col("event_id") % 19 != 0, F.col("time")))
    done = validation.enrich(events, F.lit(as_of(spark, sf_dir)).cast("timestamp"), F.lit("worker-1"))
    return done.select("event_id", "time", "ingested_at", "host")


@query(
    "ingest_outcomes",
    sql(
        "SELECT service, level, status, count(*) AS n FROM (SELECT "
        "CASE WHEN status <> 'unmarshal_error' AND event_id % 43 <> 0 THEN service END AS service, "
        "CASE WHEN status <> 'unmarshal_error' THEN CASE WHEN event_id % 37 = 0 THEN 'TRACE' ELSE level END END AS level, status "
        f"FROM (SELECT *, {_STATUS} AS status FROM tel)) GROUP BY ALL",
        "tel",
    ),
)
def ingest_outcomes(spark, sf_dir):
    parsed = validation.parse_json_events(raw_json(spark, sf_dir))
    broken = F.col("status") == "unmarshal_error"
    known = parsed.withColumn("service", F.when(~broken, F.col("service"))).withColumn("level", F.when(~broken, F.col("level")))
    return validation.outcome_counts(known)


@query(
    "event_search",
    sql(
        f"SELECT event_id, {ts('time')} AS time, service, level, message FROM tel, latest WHERE time >= t - INTERVAL 168 HOUR "
        "AND level = 'ERROR' AND message ILIKE '%USER 1%' ORDER BY tel.time DESC, event_id DESC LIMIT 100",
        "tel", "latest",
    ),
)
def event_search(spark, sf_dir):
    found = listing.search_events(
        raw_telemetry(spark, sf_dir), as_of(spark, sf_dir), level="ERROR", search="USER 1", hours=168, tiebreak="event_id"
    )
    return found.select("event_id", "time", "service", "level", "message")


_ANOMALY = (
    f"SELECT {ts('time')} AS time, anomaly_id, service, {r6('score')} AS score, {r6('threshold')} AS threshold, severity, "
    f"{r6('confidence')} AS confidence, is_resolved, {ts('resolved_at')} AS resolved_at FROM anom"
)


@query(
    "anomaly_list",
    sql(
        f"{_ANOMALY}, latest WHERE anom.time >= t - INTERVAL 7 DAY AND severity = 'HIGH' AND NOT is_resolved "
        "ORDER BY anom.time DESC, anomaly_id LIMIT 100",
        "anom", "latest",
    ),
)
def anomaly_list(spark, sf_dir):
    return listing.list_anomalies(
        anomalies(spark, sf_dir), as_of(spark, sf_dir), severity="HIGH", is_resolved=False
    ).drop("features")


@query("anomaly_by_id", sql(f"{_ANOMALY} WHERE anomaly_id = (SELECT min(anomaly_id) FROM anom)", "anom"))
def anomaly_by_id(spark, sf_dir):
    rows = anomalies(spark, sf_dir)
    wanted = rows.agg(F.min("anomaly_id")).scalar()
    return listing.anomaly_by_id(rows, wanted).drop("features")


_REPORT = (
    "SELECT report_id, anomaly_id, service, severity, model, CAST(tokens_used AS BIGINT) AS tokens_used, "
    f"{r6('cost_usd')} AS cost_usd, {ts('generated_at')} AS generated_at"
)


@query("report_by_id", sql(f"{_REPORT}, content FROM reps WHERE report_id = (SELECT max(report_id) FROM reps)", "reps"))
def report_by_id(spark, sf_dir):
    rows = report_rows(spark, sf_dir)
    wanted = rows.agg(F.max("report_id")).scalar()
    return listing.report_by_id(rows, rows, wanted).select(
        "report_id", "anomaly_id", "service", "severity", "model", "tokens_used", "cost_usd", "generated_at", "content"
    )


@query(
    "report_list",
    sql(f"{_REPORT} FROM reps WHERE contains(report_id, 'payment') ORDER BY reps.generated_at DESC, report_id LIMIT 10", "reps"),
)
def report_list(spark, sf_dir):
    return listing.list_reports(report_rows(spark, sf_dir), "payment").select(
        "report_id", "anomaly_id", "service", "severity", "model", "tokens_used", "cost_usd", "generated_at"
    )


@query(
    "recent_reports",
    sql(
        f"SELECT report_id, service, severity, model, CAST(tokens_used AS BIGINT) AS tokens_used, {r6('round(cost_usd, 4)')} AS cost, "
        f"{ts('generated_at')} AS generated_at FROM reps ORDER BY reps.generated_at DESC, report_id LIMIT 10",
        "reps",
    ),
)
def recent_reports(spark, sf_dir):
    return listing.recent_reports(report_rows(spark, sf_dir))


@query(
    "resolve_anomalies",
    sql(
        "SELECT anomaly_id, is_resolved OR severity = 'CRITICAL' AS is_resolved, "
        f"{ts('''CASE WHEN severity = 'CRITICAL' THEN time + INTERVAL 30 MINUTE ELSE resolved_at END''')} AS resolved_at FROM anom",
        "anom",
    ),
)
def resolve_anomalies(spark, sf_dir):
    rows = anomalies(spark, sf_dir)
    fixed = rows.where("severity = 'CRITICAL'").select("anomaly_id", (F.col("time") + F.expr("INTERVAL 30 MINUTES")).alias("resolved_at"))
    return listing.resolve_anomalies(rows, fixed).select("anomaly_id", "is_resolved", "resolved_at")


@query(
    "recent_anomalies_shap",
    sql(
        f"SELECT {ts('time')} AS time, anomaly_id, service, severity, {r6('round(score, 3)')} AS score, feature AS top_feature, "
        f"{r6('round(value, 3)')} AS value, {r6('round(shap, 3)')} AS shap, "
        "CASE WHEN shap < 0 THEN 'toward_anomaly' ELSE 'toward_normal' END AS direction FROM attr, latest "
        "WHERE rank = 1 AND attr.time > t - INTERVAL 24 HOUR ORDER BY attr.time DESC, anomaly_id LIMIT 20",
        "attr", "latest",
    ),
)
def recent_anomalies_shap(spark, sf_dir):
    return listing.anomalies_with_top_feature(anomalies(spark, sf_dir), as_of(spark, sf_dir))


@query(
    "table_stats",
    sql(
        "SELECT 'total_events' AS label, count(*) AS n FROM tel UNION ALL SELECT 'total_anomalies', count(*) FROM anom "
        "UNION ALL SELECT 'total_reports', count(*) FROM reps UNION ALL SELECT 'services', count(DISTINCT service) FROM tel",
        "tel", "anom", "reps",
    ),
)
def table_stats(spark, sf_dir):
    return rollups.table_stats(raw_telemetry(spark, sf_dir), anomalies(spark, sf_dir), report_rows(spark, sf_dir))


@query(
    "json_fields",
    sql(
        f"SELECT event_id, has_latency, {r6('latency_ms')} AS latency_ms, endpoint FROM tel",
        "tel",
    ),
)
def json_fields(spark, sf_dir):
    return telemetry(spark, sf_dir).select("event_id", "has_latency", "latency_ms", "endpoint")


@query("valid_latency", sql(f"SELECT event_id, {r6('valid_latency')} AS valid_latency FROM tel WHERE valid_latency IS NOT NULL", "tel"))
def valid_latency(spark, sf_dir):
    return telemetry(spark, sf_dir).where("valid_latency IS NOT NULL").select("event_id", "valid_latency")


@query(
    "parse_times",
    sql(
        f"SELECT event_id, {ts('CASE WHEN event_id % 5 = 4 THEN NULL WHEN event_id % 5 = 2 THEN time - INTERVAL 2 HOUR ELSE time END')} "
        "AS time FROM tel",
        "tel",
    ),
)
def parse_times(spark, sf_dir):
    """Stamps as text with Z, naive, with offset +02:00, with +00:00, and broken."""
    i, text = F.col("event_id") % 5, F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    stamp = (
        F.when(i == 0, F.concat(text, F.lit("Z")))
        .when(i == 1, text)
        .when(i == 2, F.concat(text, F.lit("+02:00")))
        .when(i == 3, F.concat(text, F.lit("+00:00")))
        .otherwise(F.concat(F.lit("at "), text))
    )
    return raw_telemetry(spark, sf_dir).select("event_id", iso_timestamp(stamp).alias("time"))


@query(
    "anomaly_ids",
    sql(
        "SELECT DISTINCT 'anomaly_' || service || '_' || (epoch_us(time) // 1000000) AS anomaly_id, "
        "CASE WHEN length(text) > 100 THEN substring(text, 1, 97) || '...' ELSE text END AS message FROM "
        f"(SELECT *, message || repeat(' again', CAST(event_id % 20 AS INT)) AS text FROM tel WHERE {ERR})",
        "tel",
    ),
)
def anomaly_ids(spark, sf_dir):
    from vigilspark.functions.scalars import is_error, truncate

    long_text = F.concat("message", F.expr("repeat(' again', CAST(event_id % 20 AS INT))"))
    return (
        raw_telemetry(spark, sf_dir)
        .where(is_error())
        .select(alerts.anomaly_id(F.col("service"), F.col("time")).alias("anomaly_id"), truncate(long_text).alias("message"))
        .distinct()
    )


@query(
    "parse_reports",
    sql(
        "SELECT anomaly_id AS incident_id, step < 2 AS parsed_ok, service, "
        "CASE WHEN step < 2 THEN severity ELSE severity END AS severity, "
        f"{r6('CASE WHEN step < 2 THEN 0.75 ELSE 0.5 END')} AS confidence, "
        "CASE WHEN step < 2 THEN 'Errors rose on ' || service WHEN step = 2 THEN 'Sorry, no JSON for ' || service "
        "ELSE '{\"incident_id\": \"x\"}' END AS executive_summary, CAST(CASE WHEN step < 2 THEN 2 ELSE 0 END AS INT) AS n_actions "
        "FROM (SELECT *, (epoch_us(generated_at) // 60000000) % 4 AS step FROM reps)",
        "reps",
    ),
)
def parse_reports(spark, sf_dir):
    parsed = reports.parse_responses(response_rows(spark, sf_dir))
    return parsed.select(
        "incident_id", "parsed_ok", "report.service", "report.severity", "report.confidence", "report.executive_summary",
        F.size("report.recommended_actions").alias("n_actions"),
    )


_NL2 = "chr(10) || chr(10)"


@query(
    "report_markdown",
    sql(
        f"SELECT anomaly_id AS incident_id, concat_ws({_NL2}, '# Incident Report: ' || anomaly_id, '**Service**: `' || service || '`  ' || chr(10) || "
        "'**Detected**: ' || seen || '  ' || chr(10) || '**Severity**: ' || severity || '  ' || chr(10) || '**Model confidence**: ' || "
        f"CASE WHEN k < 2 THEN '0.75' ELSE '0.50' END, '---', '## Executive summary' || {_NL2} || CASE k WHEN 2 THEN 'Sorry, no JSON for ' || service "
        "WHEN 3 THEN '{\"incident_id\": \"x\"}' ELSE 'Errors rose on ' || service END, "
        f"'## Root cause hypothesis' || {_NL2} || CASE WHEN k < 2 THEN 'error_rate drove the score' ELSE "
        "'Structured parse failed; see executive summary for the raw model output.' END, "
        f"CASE WHEN k < 2 THEN '## Top contributing features (SHAP)' || {_NL2} || '| Feature | Value | SHAP | Direction |' || chr(10) || '|---|---|---|---|' || chr(10) || "
        f"'| `error_rate` | ' || {fixed('0.05::DOUBLE - score', 3)} || ' | ' || {fixed('score - 0.05::DOUBLE', 3, '+')} || ' | ' || "
        "CASE WHEN score < 0.05::DOUBLE THEN 'toward_anomaly' ELSE 'toward_normal' END || ' |' END, "
        f"CASE WHEN k < 2 THEN '## Recommended actions' || {_NL2} || '### Immediate' || {_NL2} || '- **Roll back** — errors' || {_NL2} || '### Long Term' || {_NL2} || "
        f"'- **Add limits** — load' END, CASE WHEN k < 2 THEN '## Monitoring follow-up' || {_NL2} || '- error_rate' || chr(10) || '- p95_latency_ms' END, '---', "
        "'*Generated at ' || strftime(t, '%Y-%m-%dT%H:%M:%S') || '*') AS markdown FROM (SELECT *, strftime(generated_at, '%Y-%m-%d %H:%M:%S') AS seen, "
        "(epoch_us(generated_at) // 60000000) % 4 AS k FROM reps), latest",
        "reps", "latest",
    ),
)
def report_markdown(spark, sf_dir):
    parsed = reports.parse_responses(response_rows(spark, sf_dir))
    return reports.report_markdown(parsed, as_of(spark, sf_dir)).select("incident_id", "markdown")
