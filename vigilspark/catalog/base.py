"""Query registry and the mapping of the supplied test tables to the canonical shapes.

Every fixture is one projection or grouping over a whole supplied table, written once for Spark and once
as SQL text, so a check compares two independent derivations.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.functions.scalars import direction, in_buckets, is_error, with_metadata_fields
from vigilspark.operators import alerts, features, reports, windows
from vigilspark.schema import FEATURE_NAMES, KNOWN_SERVICES, MODEL_PRICES, service_columns
from vigilspark.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

WINDOW_S, STRIDE_S = 6 * 3600, 3 * 3600
THRESHOLD = -0.17
SERVICES = (*KNOWN_SERVICES, "billing-service", "ledger-service")
SCENARIO_TYPES = (
    "latency_spike", "error_burst", "partial_outage", "dependency_failure", "cascading_timeout", "traffic_surge",
)
MODELS = (*[m[0] for m in MODEL_PRICES], "unknown-model")
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def query(name: str, sql: str | None = None):
    """Register a query; its result is put into comparable form (times as text, doubles to 6 digits)."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")  # the data model's time zone
            return comparable(fn(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def comparable(df: DataFrame) -> DataFrame:
    def column(name: str, kind: str) -> str:
        if kind in ("timestamp", "timestamp_ntz"):
            return f"date_format(`{name}`, '{TIME_FORMAT}') AS `{name}`"
        if kind == "date":
            return f"CAST(`{name}` AS STRING) AS `{name}`"
        if kind in ("double", "float"):
            return f"round(`{name}`, 6) + 0.0D AS `{name}`"
        return f"`{name}`"

    return df.selectExpr(*[column(n, k) for n, k in df.dtypes])


# -- Spark side ---------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


_BOUNDS: dict[tuple[str, str], tuple[datetime, datetime]] = {}


def _bounds(spark: SparkSession, sf_dir: str) -> tuple[datetime, datetime]:
    """First and last event time; the supplied tables do not change during an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BOUNDS:
        _BOUNDS[key] = tuple(table(spark, sf_dir, "events").agg(F.min("ts"), F.max("ts")).first())
    return _BOUNDS[key]


def as_of(spark: SparkSession, sf_dir: str) -> datetime:
    """The moment the queries take as now: the newest event. A literal, so filters reach the scan."""
    return _bounds(spark, sf_dir)[1]


def timeline(spark: SparkSession, sf_dir: str) -> tuple[datetime, datetime]:
    low, high = _bounds(spark, sf_dir)
    midnight = dict(hour=0, minute=0, second=0, microsecond=0)
    return low.replace(**midnight), high.replace(**midnight) + timedelta(days=1)


def raw_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table in the canonical event schema, metadata as JSON text."""
    services = "array('" + "', '".join(SERVICES) + "')"
    return events_table(spark, sf_dir).selectExpr(
        "event_id",
        "CAST(ts AS TIMESTAMP) AS time",
        f"get({services}, CAST(user_id % 10 AS INT)) AS service",
        """CASE WHEN event_type = 'error' AND value >= 100 THEN 'CRITICAL' WHEN event_type = 'error' THEN 'ERROR'
           WHEN event_type = 'signup' THEN 'WARN' WHEN event_type = 'view' THEN 'DEBUG' ELSE 'INFO' END AS level""",
        "concat(event_type, ' by user ', CAST(user_id AS STRING)) AS message",
        """concat('{', concat_ws(', ',
             CASE WHEN event_id % 17 = 0 THEN CAST(NULL AS STRING)
                  WHEN event_id % 23 = 0 THEN concat('"latency_ms": "', CAST(value AS STRING), '"')
                  WHEN event_id % 29 = 0 THEN '"latency_ms": 0'
                  WHEN event_id % 41 = 0 THEN '"latency_ms": null'
                  ELSE concat('"latency_ms": ', CAST(value AS STRING)) END,
             concat('"endpoint": "/ep', CAST(CAST(get_json_object(props, '$.k') AS INT) % 5 AS STRING), '"')), '}') AS metadata""",
        "concat('trace-', CAST(event_id DIV 10 AS STRING)) AS trace_id",
        "concat('span-', CAST(event_id AS STRING)) AS span_id",
        "concat('host-', CAST(user_id % 4 AS STRING)) AS host",
        "timestamp_micros(unix_micros(CAST(ts AS TIMESTAMP)) + (event_id % 50) * 1000) AS ingested_at",
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_metadata_fields(raw_telemetry(spark, sf_dir))


def raw_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wire messages: every 31st cut short, every 37th with a bad level, every 43rd without service."""
    t, i = raw_telemetry(spark, sf_dir), F.col("event_id")
    text = F.concat(
        F.lit('{"timestamp": "'), F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
        F.when(i % 43 == 0, F.lit('"')).otherwise(F.concat(F.lit('", "service": "'), "service", F.lit('"'))),
        F.lit(', "level": "'), F.when(i % 37 == 0, "TRACE").otherwise(F.col("level")),
        F.lit('", "message": "'), "message", F.lit('", "metadata": '), "metadata", F.lit("}"),
    )
    return t.select("event_id", F.when(i % 31 == 0, F.substring(text, 1, 40)).otherwise(text).alias("raw"))


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scenario on every even day that has events, two overlapping ones on every sixth."""
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("d")).distinct()
    dom, day = F.dayofmonth("d"), F.unix_date("d").cast("bigint")
    start = F.col("d").cast("timestamp") + F.make_dt_interval(hours=6 + dom % 5)

    def scenario(k: int, delay_h: int):
        begin = start + F.make_dt_interval(hours=F.lit(delay_h))
        return F.struct(
            (day * 2 + k).alias("scenario_id"),
            F.get(F.array(*[F.lit(t) for t in SCENARIO_TYPES]), ((dom + k) % 6).cast("int")).alias("type"),
            begin.alias("start_ts"),
            (begin + F.make_dt_interval(hours=2 + dom % 4)).alias("end_ts"),
        )

    both = F.when(dom % 6 == 0, F.array(scenario(0, 0), scenario(1, 1))).otherwise(F.array(scenario(0, 0)))
    return days.where(dom % 2 == 0).select(F.inline(both))


def timeline_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scenarios as timeline documents, one per week."""
    s = scenarios(spark, sf_dir)
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    item = F.struct("scenario_id", "type", iso(F.col("start_ts")).alias("start_utc"), iso(F.col("end_ts")).alias("end_utc"))
    return (
        s.groupBy(F.date_trunc("week", "start_ts").alias("week"))
        .agg(F.array_sort(F.collect_list(item)).alias("scenarios"))
        .select("week", F.to_json(F.struct(iso(F.col("week")).alias("start_utc"), "scenarios")).alias("document"))
    )


def windowed(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    start, end = timeline(spark, sf_dir)
    return windows.assign_windows(
        telemetry(spark, sf_dir) if events is None else events, start, end, WINDOW_S, STRIDE_S
    )


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.window_features(windowed(spark, sf_dir))


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature rows written once, for queries that read them more than once."""
    return materialize(feature_rows(spark, sf_dir))


def window_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two features the rule score needs, without the per-service columns."""
    rows = windowed(spark, sf_dir, raw_telemetry(spark, sf_dir))
    return (
        rows.groupBy("window_start", "window_end")
        .agg(F.count("*").alias("n"), F.avg(is_error().cast("double")).alias("error_rate"))
        .where(F.col("n") >= 10)
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled windows with the rule score 0.05 - error rate, written once: evaluations read them repeatedly."""
    labelled = windows.label_windows(materialize(window_rates(spark, sf_dir)), scenarios(spark, sf_dir))
    return materialize(labelled.withColumn("score", F.round(F.lit(0.05) - F.col("error_rate"), 6)))


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services' aligned 6 h windows with more than 25 % errors, in the stored anomaly form."""
    grouped = (
        telemetry(spark, sf_dir)
        .groupBy(in_buckets("time", "6 hours").alias("w"), "service")
        .agg(
            F.count("*").alias("n"),
            F.avg(is_error().cast("double")).alias("er"),
            F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("lat"),
            F.max("time").alias("time"),
        )
        .where(F.col("er") > 0.25)
        .withColumn("score", F.round(F.lit(0.05) - F.col("er"), 6))
    )
    names = F.array(F.lit("event_count"), F.lit("error_rate"), F.lit("avg_latency"))
    values = F.array(F.col("n").cast("double"), F.col("er"), F.col("lat"))
    shap = F.array(-F.col("n") / 1000.0, -F.col("er"), (F.col("lat") - 50) / 700.0)
    resolved = F.hour("w") == 12
    return grouped.select(
        "time",
        alerts.anomaly_id(F.col("service"), F.col("time")).alias("anomaly_id"),
        "service",
        "score",
        F.lit(-0.2).alias("threshold"),
        F.upper(alerts.severity(F.col("score"), F.col("er"))).alias("severity"),
        F.struct(
            F.map_from_arrays(names, values).alias("values"),
            alerts.top_features(names, values, shap).alias("top_features"),
            F.col("n").alias("window_size"),
            F.col("w").alias("window_start"),
            (F.col("w") + F.expr("INTERVAL 6 HOURS")).alias("window_end"),
        ).alias("features"),
        F.least(F.lit(1.0), F.col("er") * 2).alias("confidence"),
        resolved.alias("is_resolved"),
        F.when(resolved, F.col("time") + F.expr("INTERVAL 1 HOUR")).alias("resolved_at"),
        F.col("time").alias("created_at"),
    )


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports for two of three anomalies, cost from tokens."""
    a = anomalies(spark, sf_dir)
    step = F.floor(F.unix_timestamp("features.window_start") / 21_600)
    service_no = F.array_position(F.array(*[F.lit(s) for s in SERVICES]), F.col("service")) - 1
    n = F.col("features.window_size")
    used = a.where((step + service_no) % 3 != 0).select(
        F.concat(F.lit("report_"), "anomaly_id").alias("report_id"),
        "anomaly_id",
        "service",
        "severity",
        "score",
        F.get(F.array(*[F.lit(m) for m in MODELS]), (step % 6).cast("int")).alias("model"),
        (800 + 10 * n).alias("input_tokens"),
        (400 + (n * 7) % 500).alias("output_tokens"),
        (1000.0 + n).alias("generation_time_ms"),
        (F.col("time") + F.expr("INTERVAL 5 MINUTES")).alias("generated_at"),
    )
    return (
        reports.report_cost(used)
        .withColumn("tokens_used", F.col("input_tokens") + F.col("output_tokens"))
        .withColumn("content", F.concat(F.lit("# Incident "), "anomaly_id", F.lit("\n\nSeverity "), "severity"))
        .withColumn("s3_location", F.lit(None).cast("string"))
    )


def response_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw response texts for the reports: plain JSON, fenced JSON, prose, and an incomplete object."""
    r = report_rows(spark, sf_dir)
    step = F.floor(F.unix_timestamp("generated_at") / 60) % 4
    body = F.to_json(
        F.struct(
            F.col("anomaly_id").alias("incident_id"),
            "service",
            F.date_format("generated_at", "yyyy-MM-dd HH:mm:ss").alias("detected_at"),
            "severity",
            F.lit(0.75).alias("confidence"),
            F.concat(F.lit("Errors rose on "), "service").alias("executive_summary"),
            F.lit("error_rate drove the score").alias("root_cause_hypothesis"),
            F.array(
                F.struct(
                    F.lit("error_rate").alias("name"), (0.05 - F.col("score")).alias("value"),
                    (F.col("score") - 0.05).alias("shap"), direction(F.col("score") - 0.05).alias("direction"),
                )
            ).alias("contributing_features"),
            F.array(
                F.struct(F.lit("long_term").alias("timeframe"), F.lit("Add limits").alias("action"), F.lit("load").alias("rationale")),
                F.struct(F.lit("immediate").alias("timeframe"), F.lit("Roll back").alias("action"), F.lit("errors").alias("rationale")),
            ).alias("recommended_actions"),
            F.array(F.lit("error_rate"), F.lit("p95_latency_ms")).alias("monitoring_checks"),
        )
    )
    response = (
        F.when(step == 0, body)
        .when(step == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(step == 2, F.concat(F.lit("Sorry, no JSON for "), "service"))
        .otherwise(F.lit('{"incident_id": "x"}'))
    )
    return r.select(
        F.col("anomaly_id").alias("incident_id"), "service",
        F.date_format("generated_at", "yyyy-MM-dd HH:mm:ss").alias("detected_at"), "severity", response.alias("response"),
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-metric series per stream (user_id % 20): value, and value x k; labelled by the scenarios."""
    from vigilspark.plans.ordering import global_rank, time_cells

    e = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 20).cast("string").alias("stream"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    ranked = global_rank(e, time_cells(F.col("ts"), 86_400), [F.col("ts"), F.col("event_id")], "i", ["stream"])
    both = F.array(
        F.struct(F.lit(0).alias("metric"), F.col("value").alias("value")),
        F.struct(F.lit(1).alias("metric"), (F.col("value") * F.col("k")).alias("value")),
    )
    return ranked.withColumn("i", F.col("i") - 1).select("stream", "i", "ts", F.inline(both))


def stream_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label spans per stream: every scenario, for the streams its id selects."""
    every = F.sequence(F.lit(0), F.lit(19))
    streams = F.transform(F.filter(every, lambda s: (s + F.col("scenario_id")) % 3 != 0), lambda s: s.cast("string"))
    return scenarios(spark, sf_dir).select(
        F.explode(streams).alias("stream"),
        F.col("start_ts").alias("span_start"),
        F.col("end_ts").alias("span_end"),
    )


def labelled_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series with labels, written once: normalising and windowing read it repeatedly."""
    from vigilspark.operators.series import label_points

    return materialize(label_points(series(spark, sf_dir), stream_spans(spark, sf_dir)))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token use per conversation: text lengths of the asking and the answering side."""
    asked = F.col("role") == "user"
    return (
        table(spark, sf_dir, "conversations")
        .groupBy("conv_id")
        .agg(
            F.sum(F.when(asked, F.length("text")).otherwise(0)).alias("input_tokens"),
            F.sum(F.when(~asked, F.length("text")).otherwise(0)).alias("output_tokens"),
        )
        .withColumn("model", F.get(F.array(*[F.lit(m) for m in MODELS]), (F.col("conv_id") % 6).cast("int")))
    )


def rule_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alert per service, severity and hour with error events, at the last of them (one check an hour)."""
    severity = F.when(F.col("level") == "CRITICAL", "critical").otherwise("warning")
    hourly = (
        raw_telemetry(spark, sf_dir)
        .where(is_error())
        .groupBy("service", severity.alias("severity"), in_buckets("time", "1 hour").alias("check"))
        .agg(F.max("time").alias("time"), F.max("event_id").alias("last_id"))
    )
    return hourly.select(
        "time",
        F.concat(F.lit("a"), F.lpad(F.col("last_id").cast("string"), 12, "0")).alias("anomaly_id"),
        "service",
        "severity",
        F.when(F.col("severity") == "critical", "HighLatency").otherwise("HighErrorRate").alias("alertname"),
    )


# -- SQL side -----------------------------------------------------------------


def ts(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S.%f')"


def r6(expression: str) -> str:
    return f"(round(CAST({expression} AS DOUBLE), 6) + 0.0)"


def fixed(expression: str, digits: int, sign: str = "") -> str:
    """A number printed with ``digits`` decimals: noise beyond the sixth decimal dropped, then half up."""
    exact = f"CAST(round(CAST({expression} AS DOUBLE), 6) AS DECIMAL(24, 6))"
    return f"printf('%{sign}.{digits}f', CAST(round({exact}, {digits}) AS DOUBLE))"


def sql_list(items) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + "]"


def q(name: str) -> str:
    return f'"{name}"'


_ERR = "level IN ('ERROR', 'CRITICAL')"


def _feature_sql() -> str:
    per = []
    for s in KNOWN_SERVICES:
        rate, p95 = service_columns(s)
        per.append(
            f"CASE WHEN count(*) FILTER (service = '{s}') = 0 THEN 0.0 ELSE "
            f"CAST(count(*) FILTER (service = '{s}' AND {_ERR}) AS DOUBLE) / count(*) FILTER (service = '{s}') END AS {q(rate)}"
        )
        per.append(f"coalesce(quantile_cont(valid_latency, 0.95) FILTER (service = '{s}'), 0.0) AS {q(p95)}")
    return f"""
SELECT window_start, window_end, event_count, error_rate, p50_latency_ms, p95_latency_ms, p99_latency_ms, latency_std,
  p95_latency_ms / (p50_latency_ms + 1) AS p95_p50_ratio, p99_latency_ms / (p95_latency_ms + 1) AS p99_p95_ratio,
  event_count * error_rate AS error_count, ln(1 + event_count) AS log_event_count, ln(1 + error_rate * 1000) AS log_error_rate,
  {", ".join(q(c) for s in KNOWN_SERVICES for c in service_columns(s))}
FROM (SELECT window_start, window_end, CAST(count(*) AS DOUBLE) AS event_count,
    CAST(count(*) FILTER ({_ERR}) AS DOUBLE) / count(*) AS error_rate,
    coalesce(quantile_cont(valid_latency, 0.5), 0.0) AS p50_latency_ms,
    coalesce(quantile_cont(valid_latency, 0.95), 0.0) AS p95_latency_ms,
    coalesce(quantile_cont(valid_latency, 0.99), 0.0) AS p99_latency_ms,
    coalesce(stddev_pop(valid_latency), 0.0) AS latency_std,
    {", ".join(per)}
  FROM ewin GROUP BY window_start, window_end HAVING count(*) >= 10)"""


def severity_sql(score: str, rate: str) -> str:
    return (
        f"CASE WHEN {score} < -1.0 OR {rate} > 0.5 THEN 'critical' WHEN {score} < -0.85 OR {rate} > 0.3 THEN 'high' "
        f"WHEN {score} < -0.7 OR {rate} > 0.15 THEN 'medium' ELSE 'low' END"
    )


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "latest": ((), "SELECT max(ts) AS t FROM events"),
    "tl": (
        (),
        "SELECT CAST(date_trunc('day', min(ts)) AS TIMESTAMP) AS s, "
        "CAST(date_trunc('day', max(ts)) AS TIMESTAMP) + INTERVAL 1 DAY AS e FROM events",
    ),
    "tel": (
        (),
        f"""SELECT event_id, CAST(ts AS TIMESTAMP) AS time,
  list_extract({sql_list(SERVICES)}, CAST(user_id % 10 AS INT) + 1) AS service,
  CASE WHEN event_type = 'error' AND value >= 100 THEN 'CRITICAL' WHEN event_type = 'error' THEN 'ERROR'
       WHEN event_type = 'signup' THEN 'WARN' WHEN event_type = 'view' THEN 'DEBUG' ELSE 'INFO' END AS level,
  event_type || ' by user ' || user_id AS message,
  event_id % 17 <> 0 AS has_latency,
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 23 = 0 THEN value WHEN event_id % 29 = 0 THEN 0.0
       WHEN event_id % 41 = 0 THEN NULL ELSE value END AS latency_ms,
  CASE WHEN event_id % 17 = 0 OR event_id % 23 = 0 OR event_id % 29 = 0 OR event_id % 41 = 0 THEN NULL ELSE value END AS valid_latency,
  '/ep' || (CAST(regexp_extract(props, '[0-9]+') AS INT) % 5) AS endpoint,
  'trace-' || (event_id // 10) AS trace_id, 'span-' || event_id AS span_id, 'host-' || (user_id % 4) AS host,
  CAST(ts AS TIMESTAMP) + to_milliseconds(event_id % 50) AS ingested_at
FROM events""",
    ),
    "wins": (
        ("tl",),
        "SELECT g AS window_start, g + INTERVAL 6 HOUR AS window_end FROM "
        "(SELECT unnest(generate_series(s, e - INTERVAL 6 HOUR, INTERVAL 3 HOUR)) AS g FROM tl)",
    ),
    "ewin": (
        ("wins", "tel"),
        "SELECT w.window_start, w.window_end, tel.* FROM wins w JOIN tel ON time >= window_start AND time < window_end",
    ),
    "feat": (("ewin",), _feature_sql()),
    "scen": (
        (),
        f"""SELECT CAST(date_diff('day', DATE '1970-01-01', d) * 2 + k AS BIGINT) AS scenario_id,
  list_extract({sql_list(SCENARIO_TYPES)}, CAST((day(d) + k) % 6 AS INT) + 1) AS type,
  CAST(d AS TIMESTAMP) + to_hours(CAST(6 + day(d) % 5 + k AS INT)) AS start_ts,
  CAST(d AS TIMESTAMP) + to_hours(CAST(6 + day(d) % 5 + k + 2 + day(d) % 4 AS INT)) AS end_ts
FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events), (SELECT unnest([0, 1]) AS k)
WHERE day(d) % 2 = 0 AND (k = 0 OR day(d) % 6 = 0)""",
    ),
    "labels_w": (
        ("wins", "scen"),
        "SELECT w.window_start, w.window_end, arg_min(type, scenario_id) AS scenario_type, "
        "CAST(count(scenario_id) > 0 AS INT) AS label FROM wins w LEFT JOIN scen s "
        "ON s.start_ts < w.window_end AND s.end_ts > w.window_start GROUP BY 1, 2",
    ),
    "scored": (
        ("ewin", "labels_w"),
        f"""SELECT r.*, l.label, l.scenario_type, round(0.05::DOUBLE - r.error_rate, 6) AS score FROM
  (SELECT window_start, window_end, count(*) AS n, CAST(count(*) FILTER ({_ERR}) AS DOUBLE) / count(*) AS error_rate
   FROM ewin GROUP BY 1, 2 HAVING count(*) >= 10) r JOIN labels_w l USING (window_start, window_end)""",
    ),
    "anom": (
        ("tel",),
        f"""SELECT time, 'anomaly_' || service || '_' || (epoch_us(time) // 1000000) AS anomaly_id, service, score,
  CAST(-0.2 AS DOUBLE) AS threshold, upper({severity_sql('score', 'er')}) AS severity, n AS window_size, er, lat,
  w AS window_start, w + INTERVAL 6 HOUR AS window_end, least(1.0::DOUBLE, er * 2) AS confidence, hour(w) = 12 AS is_resolved,
  CASE WHEN hour(w) = 12 THEN time + INTERVAL 1 HOUR END AS resolved_at FROM
  (SELECT *, round(0.05::DOUBLE - er, 6) AS score FROM
    (SELECT time_bucket(INTERVAL 6 HOUR, time) AS w, service, count(*) AS n, CAST(count(*) FILTER ({_ERR}) AS DOUBLE) / count(*) AS er,
      coalesce(avg(latency_ms), 0.0) AS lat, max(time) AS time FROM tel GROUP BY 1, 2) WHERE er > 0.25::DOUBLE)""",
    ),
    "attr": (
        ("anom",),
        """SELECT anomaly_id, time, service, severity, score, feature, value, shap, row_number() OVER
    (PARTITION BY anomaly_id ORDER BY abs(shap) DESC, pos) AS rank FROM (
  SELECT anomaly_id, time, service, severity, score, 0 AS pos, 'event_count' AS feature, CAST(window_size AS DOUBLE) AS value,
    -CAST(window_size AS DOUBLE) / 1000.0 AS shap FROM anom UNION ALL
  SELECT anomaly_id, time, service, severity, score, 1, 'error_rate', er, -er FROM anom UNION ALL
  SELECT anomaly_id, time, service, severity, score, 2, 'avg_latency', lat, (lat - 50) / 700.0 FROM anom)""",
    ),
    "prices": (
        (),
        "SELECT * FROM (VALUES " + ", ".join(f"('{m}', {i}::DOUBLE, {o}::DOUBLE)" for m, i, o, _ in MODEL_PRICES)
        + ") p(model, input_per_m, output_per_m)",
    ),
    "reps": (
        ("anom", "prices"),
        f"""SELECT u.*, p.input_per_m IS NULL AS price_is_default, input_tokens + output_tokens AS tokens_used,
  round(input_tokens * (coalesce(p.input_per_m, 0.075) / 1e6) + output_tokens * (coalesce(p.output_per_m, 0.3) / 1e6), 6) AS cost_usd,
  '# Incident ' || anomaly_id || chr(10) || chr(10) || 'Severity ' || severity AS content FROM
  (SELECT 'report_' || anomaly_id AS report_id, anomaly_id, service, severity, score,
    list_extract({sql_list(MODELS)}, CAST((epoch_us(window_start) // 21600000000) % 6 AS INT) + 1) AS model,
    800 + 10 * window_size AS input_tokens, 400 + (window_size * 7) % 500 AS output_tokens,
    CAST(1000 + window_size AS DOUBLE) AS generation_time_ms, time + INTERVAL 5 MINUTE AS generated_at
   FROM anom WHERE (epoch_us(window_start) // 21600000000 + list_position({sql_list(SERVICES)}, service) - 1) % 3 <> 0) u
  LEFT JOIN prices p USING (model)""",
    ),
    "ser1": (
        (),
        "SELECT CAST(user_id % 20 AS VARCHAR) AS stream, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) - 1 AS i, "
        "CAST(ts AS TIMESTAMP) AS ts, value AS v0, value * CAST(regexp_extract(props, '[0-9]+') AS INT) AS v1 FROM events",
    ),
    "ser2": (
        ("ser1",),
        "SELECT stream, i, ts, 0 AS metric, v0 AS value FROM ser1 UNION ALL SELECT stream, i, ts, 1, v1 FROM ser1",
    ),
    "spans": (
        ("scen",),
        "SELECT CAST(s AS VARCHAR) AS stream, start_ts AS span_start, end_ts AS span_end FROM scen, "
        "(SELECT unnest(range(0, 20)) AS s) WHERE (s + scenario_id) % 3 <> 0",
    ),
    "serl": (
        ("ser2", "spans"),
        "SELECT x.*, CAST(EXISTS (SELECT 1 FROM spans p WHERE p.stream = x.stream AND x.ts BETWEEN p.span_start AND p.span_end) AS INT) "
        "AS label FROM ser2 x",
    ),
    "zs": (
        ("serl",),
        "SELECT stream, i, ts, metric, label, (value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w = 0 THEN 1 "
        "ELSE stddev_pop(value) OVER w END AS value FROM serl WINDOW w AS (PARTITION BY stream, metric)",
    ),
    "usage": (
        (),
        "SELECT conv_id, CAST(sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) AS BIGINT) AS input_tokens, "
        "CAST(sum(CASE WHEN role <> 'user' THEN length(text) ELSE 0 END) AS BIGINT) AS output_tokens, "
        f"list_extract({sql_list(MODELS)}, CAST(conv_id % 6 AS INT) + 1) AS model FROM conversations GROUP BY conv_id",
    ),
    "alr": (
        ("tel",),
        "SELECT time, 'a' || lpad(CAST(last_id AS VARCHAR), 12, '0') AS anomaly_id, service, severity, "
        "CASE WHEN severity = 'critical' THEN 'HighLatency' ELSE 'HighErrorRate' END AS alertname FROM "
        "(SELECT service, CASE WHEN level = 'CRITICAL' THEN 'critical' ELSE 'warning' END AS severity, "
        f"time_bucket(INTERVAL 1 HOUR, time) AS b, max(time) AS time, max(event_id) AS last_id FROM tel WHERE {_ERR} GROUP BY 1, 2, 3)",
    ),
}


def sql(body: str, *needs: str, extra: str = "", recursive: bool = False) -> str:
    """``body`` with the named fixture CTEs (and what they need) in front."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    parts = [f"{n} AS ({CTES[n][1]})" for n in ordered] + ([extra] if extra else [])
    head = f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" if parts else ""
    return head + body


def chain_sql(name: str, source: str, keys: str, wait: str, time: str = "time") -> str:
    """Recursive CTE: each key's first time of ``source``, then always the first at least ``wait`` later."""
    same = " AND ".join(f"a.{k.strip()} = k.{k.strip()}" for k in keys.split(","))
    later = f"{same} AND a.{time} >= k.{time} + INTERVAL {wait}"
    groups = ", ".join(str(i + 1) for i in range(len(keys.split(","))))
    mine = ", ".join(f"k.{k.strip()}" for k in keys.split(","))
    return (
        f"{name} AS (SELECT {keys}, min({time}) AS {time} FROM {source} GROUP BY {groups} UNION ALL SELECT {mine}, "
        f"(SELECT min(a.{time}) FROM {source} a WHERE {later}) FROM {name} k WHERE EXISTS (SELECT 1 FROM {source} a WHERE {later}))"
    )


def checks_sql(wait: str) -> str:
    """``ticks``: a service's checks, each at the first event at least ``wait`` after the last one or the first event."""
    return (
        chain_sql("chk", "tel", "service", wait)
        + ", ticks AS (SELECT service, time AS tick FROM chk c WHERE time > (SELECT min(time) FROM tel t WHERE t.service = c.service))"
    )


DETECTION_SQL = sql(
    f"SELECT service, {ts('tick')} AS tick, window_size, {r6('score')} AS score, score < {THRESHOLD}::DOUBLE AS is_anomaly, "
    "EXISTS (SELECT 1 FROM kept k WHERE k.service = s.service AND k.tick = s.tick) AS kept FROM sc s",
    "tel", recursive=True,
    extra=checks_sql("6 HOUR")
    + f""", buf AS (SELECT k.service, k.tick, e.level, row_number() OVER (PARTITION BY k.service, k.tick ORDER BY e.time DESC, e.event_id DESC) AS age
  FROM ticks k JOIN tel e ON e.service = k.service AND e.time <= k.tick),
sc AS (SELECT service, tick, count(*) AS window_size, round(0.05::DOUBLE - CAST(count(*) FILTER ({_ERR}) AS DOUBLE) / count(*), 6) AS score
  FROM buf WHERE age <= 50 GROUP BY service, tick HAVING count(*) >= 10),
flg AS (SELECT service, tick FROM sc WHERE score < {THRESHOLD}::DOUBLE), """
    + chain_sql("kept", "flg", "service", "24 HOUR", "tick"),
)


FEATURE_LIST_SQL = ", ".join(f"{r6(q(n))} AS {q(n)}" for n in FEATURE_NAMES)
