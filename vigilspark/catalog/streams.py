"""Streaming jobs over the whole event table, delivered in time-ordered parts, and sink round trips."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.catalog.base import (
    DETECTION_SQL, FEATURE_LIST_SQL, STRIDE_S, THRESHOLD, WINDOW_S, anomalies, as_of, checks_sql, feature_table, labelled_series, query, r6, raw_json,
    raw_telemetry, report_rows, rule_alerts, series, sql, stream_spans, telemetry, timeline, ts,
)
from vigilspark.catalog.metrics import _CONTEXT, _rollup_body
from vigilspark.operators import detection, forest
from vigilspark.operators.series import label_points
from vigilspark.session import materialize, shared_dir
from vigilspark.sources import readers, writers
from vigilspark.streaming import jobs, stateful


def _work(spark) -> str:
    """A fresh folder in the shared checkpoint location."""
    return f"{shared_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"


def _stored(rows: DataFrame, path: str) -> DataFrame:
    """A partitioned table read back with the schema of its rows; written without any, it has no file to tell it."""
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


#: State partitions of the fixture streams, as a job's author would fix them at its first start.
STATE_PARTITIONS = 4


def _stream_session(spark):
    session = stateful.stateful_session(spark)
    session.conf.set("spark.sql.shuffle.partitions", STATE_PARTITIONS)
    return session


def _drain(spark, df: DataFrame, work: str, start, time: str = "time", parts: int = 3, late_s: tuple[int, int] | None = None) -> None:
    """Deliver ``df`` in time order, part by part; after each part the job runs until it has caught up.

    Every run after the first one resumes from the checkpoint, as after a restart. With ``late_s`` the rows that lie
    between so many seconds before the end of a part come with the next one.
    """
    low, high = df.agg(F.unix_micros(F.min(time)), F.unix_micros(F.max(time))).first()
    low, high = (0, 0) if low is None else (low, high)  # without rows the parts are empty
    width = (high - low) // parts + 1
    session = _stream_session(spark)
    at = F.unix_micros(time)
    part = F.floor((at - low) / width)
    if late_s:
        before = (part + 1) * width + low - at
        late = before.between(late_s[0] * 1_000_000, late_s[1] * 1_000_000)
        part = F.least(part + F.when(late, 1).otherwise(0), F.lit(parts - 1))
    for k in range(parts):
        df.where(part == k).write.mode("append").parquet(f"{work}/in")
        start(jobs.table_stream(session, f"{work}/in", df.schema)).awaitTermination()


@query(
    "stream_rollup_1h",
    sql(
        f"SELECT {ts('bucket')} AS bucket, service, event_count, {r6('avg_latency')} AS avg_latency, {r6('p95_latency')} AS p95_latency, "
        f"{r6('p99_latency')} AS p99_latency, {r6('latency_stddev')} AS latency_stddev, {r6('error_rate')} AS error_rate, "
        f"{r6('critical_rate')} AS critical_rate, unique_endpoints FROM ({_rollup_body('1 HOUR')}), "
        "(SELECT max(time) AS last FROM tel WHERE has_latency) WHERE bucket + INTERVAL 1 HOUR <= last - INTERVAL 1 HOUR",
        "tel",
    ),
)
def stream_rollup(spark, sf_dir):
    """All buckets closed by the end offset; events of 130 to 170 minutes before each part's end come late and are folded in."""
    work = _work(spark)
    _drain(
        spark, raw_telemetry(spark, sf_dir), work,
        lambda s: jobs.rollup_job(s, "1 hour", f"{work}/out", f"{work}/state", f"{work}/ck"), late_s=(7_800, 10_200),
    )
    return jobs.rollup_table(spark, f"{work}/out")


@query(
    "stream_window_features",
    sql(
        f"SELECT {ts('window_start')} AS window_start, {ts('window_end')} AS window_end, {FEATURE_LIST_SQL} FROM feat, latest "
        "WHERE window_end <= t - INTERVAL 10 MINUTE",
        "feat", "latest",
    ),
)
def stream_window_features(spark, sf_dir):
    """Epoch-aligned windows coincide with the timeline's; the first one starts before it and is left out."""
    work = _work(spark)
    start, _ = timeline(spark, sf_dir)
    _drain(
        spark, raw_telemetry(spark, sf_dir), work, lambda s: jobs.feature_job(s, WINDOW_S, STRIDE_S, f"{work}/out", f"{work}/ck")
    )
    return spark.read.parquet(f"{work}/out").drop("batch_id").where(F.col("window_start") >= F.lit(start))


@query(
    "stream_ingest",
    sql(
        "SELECT status, count(*) AS n, count(DISTINCT event_id) AS ids FROM (SELECT event_id, CASE WHEN event_id % 31 = 0 THEN 'unmarshal_error' "
        "WHEN event_id % 37 = 0 OR event_id % 43 = 0 THEN 'validation_error' ELSE 'accepted' END AS status FROM tel) GROUP BY 1",
        "tel",
    ),
)
def stream_ingest(spark, sf_dir):
    work = _work(spark)
    lines = raw_json(spark, sf_dir).join(raw_telemetry(spark, sf_dir).select("event_id", "time"), "event_id")
    _drain(
        spark, lines, work, lambda s: jobs.ingest_job(s.drop("time"), f"{work}/events", f"{work}/bad", f"{work}/ck", "worker-1")
    )
    good = spark.read.parquet(f"{work}/events").select("event_id", F.lit("accepted").alias("status"))
    both = good.unionByName(spark.read.parquet(f"{work}/bad").select("event_id", "status"))
    return both.groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query(
    "stream_cooldown",
    sql(
        f"SELECT service, {ts('time')} AS time, anomaly_id FROM kept JOIN alr USING (service, time)",
        "alr", recursive=True,
        extra="kept AS (SELECT service, min(time) AS time FROM alr GROUP BY 1 UNION ALL SELECT k.service, "
        "(SELECT min(a.time) FROM alr a WHERE a.service = k.service AND a.time >= k.time + INTERVAL 1 HOUR) FROM kept k WHERE EXISTS "
        "(SELECT 1 FROM alr a WHERE a.service = k.service AND a.time >= k.time + INTERVAL 1 HOUR))",
    ),
)
def stream_cooldown(spark, sf_dir):
    work = _work(spark)
    _drain(
        spark, rule_alerts(spark, sf_dir), work,
        lambda s: jobs.cooldown_job(s, f"{work}/out", f"{work}/state", f"{work}/ck", 3_600), parts=2,
    )
    return spark.read.parquet(f"{work}/out").select("service", "time", "anomaly_id")


@query(
    "stream_trailing_buffer",
    sql(
        f"SELECT service, {ts('tick')} AS tick, count(*) AS n, max(event_id) AS newest, min(event_id) AS oldest FROM "
        "(SELECT k.tick, e.*, row_number() OVER (PARTITION BY k.service, k.tick ORDER BY e.time DESC, e.event_id DESC) AS age FROM ticks k JOIN tel e "
        "ON e.service = k.service AND e.time <= k.tick) WHERE age <= 50 GROUP BY service, tick",
        "tel", extra=checks_sql("24 HOUR"), recursive=True,
    ),
)
def stream_trailing_buffer(spark, sf_dir):
    work = _work(spark)
    slim = raw_telemetry(spark, sf_dir).select("event_id", "time", "service", "level")
    _drain(spark, slim, work, lambda s: jobs.trailing_buffer_job(s, f"{work}/out", f"{work}/ck", 86_400, size=50), parts=2)
    return (
        spark.read.parquet(f"{work}/out")
        .groupBy("service", "tick")
        .agg(F.count("*").alias("n"), F.max("event_id").alias("newest"), F.min("event_id").alias("oldest"))
    )


@query("stream_detection", DETECTION_SQL)
def stream_detection(spark, sf_dir):
    """Checks of each service's newest 50 events at least 6 h apart, scored by the rule, alerts at least a day apart."""
    work = _work(spark)
    slim = telemetry(spark, sf_dir).select("event_id", "time", "service", "level", "valid_latency")
    sink = jobs.detection_sink(f"{work}/checks", f"{work}/anomalies", f"{work}/alerts")
    judge = detection.RuleJudge(THRESHOLD)
    _drain(spark, slim, work, lambda s: jobs.detection_job(s, judge, sink, f"{work}/ck", 21_600, 50, 86_400), parts=2)
    raised = spark.read.parquet(f"{work}/anomalies").select("anomaly_id", F.lit(True).alias("stored"))
    rows = spark.read.parquet(f"{work}/checks").join(raised, "anomaly_id", "left")
    return rows.select("service", "tick", "window_size", "score", "is_anomaly", F.coalesce("stored", F.lit(False)).alias("kept"))


@query(
    "stream_scoring",
    sql(
        f"SELECT service, {ts('tick')} AS tick, count(*) AS window_size, true AS consistent FROM (SELECT k.service, k.tick, row_number() OVER "
        "(PARTITION BY k.service, k.tick ORDER BY e.time DESC, e.event_id DESC) AS age FROM ticks k JOIN tel e ON e.service = k.service AND "
        "e.time <= k.tick) WHERE age <= 50 GROUP BY service, tick HAVING count(*) >= 10",
        "tel", extra=checks_sql("6 HOUR"), recursive=True,
    ),
)
def stream_scoring(spark, sf_dir):
    """The same checks scored by a forest fitted on the timeline's windows. A check is consistent if it is flagged by the
    threshold, kept only if flagged, and stored with three attributions exactly if kept."""
    work = _work(spark)
    model = forest.fit(feature_table(spark, sf_dir), "window_start", threshold=0.0, trained_at=as_of(spark, sf_dir))
    slim = telemetry(spark, sf_dir).select("event_id", "time", "service", "level", "valid_latency")
    sink = jobs.detection_sink(f"{work}/checks", f"{work}/anomalies", f"{work}/alerts", model)
    judge = detection.ForestJudge(model)
    _drain(spark, slim, work, lambda s: jobs.detection_job(s, judge, sink, f"{work}/ck", 21_600, 50, 86_400), parts=2)
    stored = spark.read.parquet(f"{work}/anomalies").select("anomaly_id", F.size("features.top_features").alias("n_top"))
    rows = spark.read.parquet(f"{work}/checks").join(stored, "anomaly_id", "left")
    told = (F.coalesce("n_top", F.lit(0)) == F.when(F.col("kept"), 3).otherwise(0)) & (F.col("is_anomaly") | ~F.col("kept"))
    ok = told & (F.col("is_anomaly") == (F.col("score") < F.col("threshold")))
    return rows.select("service", "tick", "window_size", ok.alias("consistent"))


@query(
    "stream_context",
    sql(f"SELECT anomaly_id, event_id, {ts('time')} AS time, level FROM ctx", "anom", "tel", extra=_CONTEXT),
)
def stream_context(spark, sf_dir):
    work = _work(spark)
    _drain(
        spark, anomalies(spark, sf_dir).select("anomaly_id", "service", "time"), work,
        lambda s: jobs.context_job(s, lambda: raw_telemetry(spark, sf_dir), f"{work}/out", f"{work}/ck"),
    )
    return spark.read.parquet(f"{work}/out").select("anomaly_id", "event_id", "time", "level")


@query("stream_deduplicated", sql("SELECT service, count(*) AS n FROM tel GROUP BY 1", "tel"))
def stream_deduplicated(spark, sf_dir):
    """Every event delivered twice; each counts once."""
    work = _work(spark)
    rows = raw_telemetry(spark, sf_dir).select("time", "service", "trace_id", "span_id")
    _drain(
        spark, rows.unionByName(rows), work,
        lambda s: jobs.run(jobs.deduplicated(s), lambda b, i: jobs.save_batch(b, f"{work}/out", i), f"{work}/ck"),
    )
    return spark.read.parquet(f"{work}/out").groupBy("service").agg(F.count("*").alias("n"))


# -- sinks and readers, written and read back -----------------------------------------


@query(
    "sink_events",
    sql(
        f"SELECT event_id, {ts('time')} AS time, service, level FROM tel, tl WHERE time >= s + INTERVAL 3 DAY AND time < s + INTERVAL 4 DAY",
        "tel", "tl",
    ),
)
def sink_events(spark, sf_dir):
    """The event table written by date, then one day scanned back with partition pruning."""
    work = _work(spark)
    start, _ = timeline(spark, sf_dir)
    writers.write_events(raw_telemetry(spark, sf_dir), f"{work}/events")
    day = readers.scan_events(spark, f"{work}/events", start + timedelta(days=3), start + timedelta(days=4))
    return day.select("event_id", "time", "service", "level")


@query(
    "sink_compacted",
    sql(
        "SELECT service, level, count(*) AS n FROM tel, latest WHERE CAST(time AS DATE) < CAST(t AS DATE) - INTERVAL 7 DAY GROUP BY 1, 2",
        "tel", "latest",
    ),
)
def sink_compacted(spark, sf_dir):
    work = _work(spark)
    writers.write_compacted(raw_telemetry(spark, sf_dir), f"{work}/cold", as_of(spark, sf_dir), 7)
    return spark.read.parquet(f"{work}/cold").groupBy("service", "level").agg(F.count("*").alias("n"))


@query(
    "sink_anomalies",
    sql(f"SELECT anomaly_id, {r6('score')} AS score, severity, CAST(window_size AS BIGINT) AS window_size FROM anom", "anom"),
)
def sink_anomalies(spark, sf_dir):
    work = _work(spark)
    rows = anomalies(spark, sf_dir)
    writers.write_anomalies(rows, f"{work}/anomalies")
    return _stored(writers.with_event_date(rows), f"{work}/anomalies").select("anomaly_id", "score", "severity", "features.window_size")


@query("sink_alert_messages", sql("SELECT service AS key, anomaly_id, severity FROM anom", "anom"))
def sink_alert_messages(spark, sf_dir):
    work = _work(spark)
    writers.alert_messages(anomalies(spark, sf_dir)).write.json(f"{work}/alerts")
    back = spark.read.schema("key string, value string").json(f"{work}/alerts")
    return back.select(
        "key", F.get_json_object("value", "$.anomaly_id").alias("anomaly_id"), F.get_json_object("value", "$.severity").alias("severity")
    )


@query(
    "sink_report_upsert",
    sql("SELECT report_id, CASE WHEN severity = 'CRITICAL' THEN tokens_used + 1 ELSE tokens_used END AS tokens_used FROM reps", "reps"),
)
def sink_report_upsert(spark, sf_dir):
    """Critical reports written a second time with one token more, into the stored table; read back."""
    work = _work(spark)
    rows = materialize(report_rows(spark, sf_dir))
    writers.write_reports(rows, f"{work}/reports")
    new = rows.where("severity = 'CRITICAL'").withColumn("tokens_used", F.col("tokens_used") + 1)
    writers.upsert_reports(new, f"{work}/reports")
    return _stored(writers.with_event_date(rows, "generated_at"), f"{work}/reports").select("report_id", "tokens_used")


@query(
    "sink_documents",
    sql(
        "SELECT report_id, content, strftime(generated_at, '%Y/%m/%d/') || report_id || '.md' AS filepath FROM reps", "reps"
    ),
)
def sink_documents(spark, sf_dir):
    work = _work(spark)
    rows = report_rows(spark, sf_dir)
    writers.write_documents(rows, f"{work}/docs")
    return _stored(writers.dated_documents(rows), f"{work}/docs").select("report_id", "content", "filepath")


@query("sink_feature_csv", sql(f"SELECT {FEATURE_LIST_SQL} FROM feat", "feat"))
def sink_feature_csv(spark, sf_dir):
    work = _work(spark)
    writers.write_csv(feature_table(spark, sf_dir).drop("window_end"), f"{work}/features")
    return readers.read_feature_csv(spark, f"{work}/features")


@query(
    "source_event_log",
    sql(
        f"SELECT {ts('time')} AS time, service, level, message, trace_id FROM tel, tl WHERE time >= s + INTERVAL 2 DAY AND time < s + INTERVAL 5 DAY",
        "tel", "tl",
    ),
)
def source_event_log(spark, sf_dir):
    work = _work(spark)
    start, _ = timeline(spark, sf_dir)
    log = raw_telemetry(spark, sf_dir).select(
        F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("time"), "service", "level", "message", "trace_id", "span_id"
    )
    log.write.json(f"{work}/log")
    back = readers.read_event_log(spark, f"{work}/log", start + timedelta(days=2), start + timedelta(days=5))
    return back.select("time", "service", "level", "message", "trace_id")


@query(
    "source_log_stream",
    sql(
        "SELECT status, count(*) AS n, count(DISTINCT event_id) AS ids, CAST(sum(event_id) AS BIGINT) AS id_sum FROM (SELECT event_id, "
        "CASE WHEN event_id % 31 = 0 THEN 'unmarshal_error' WHEN event_id % 37 = 0 OR event_id % 43 = 0 THEN 'validation_error' ELSE 'accepted' END "
        "AS status FROM tel) GROUP BY 1",
        "tel",
    ),
)
def source_log_stream(spark, sf_dir):
    """Log files of JSON lines, broken ones among them, read as a text stream; rejected lines go to the quarantine in the
    same micro-batch. The trace id carries the event id; of lines cut short it is read from the text."""
    work = _work(spark)
    lines = raw_json(spark, sf_dir).select(F.concat(F.col("raw"), F.lit(" "), F.lit("#"), F.col("event_id").cast("string")).alias("value"))
    lines.repartition(4).write.text(f"{work}/in")
    numbered = readers.event_stream(_stream_session(spark), f"{work}/in", 2)
    text = F.regexp_extract("raw", r"^(.*) #(\d+)$", 1)
    rows = numbered.select(text.alias("raw"), F.regexp_extract("raw", r"#(\d+)$", 1).cast("bigint").alias("event_id"))
    jobs.ingest_job(rows, f"{work}/events", f"{work}/bad", f"{work}/ck", "worker-1").awaitTermination()
    good = spark.read.parquet(f"{work}/events").select("event_id", F.lit("accepted").alias("status"))
    both = good.unionByName(spark.read.parquet(f"{work}/bad").select("event_id", "status"))
    return both.groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"), F.sum("event_id").alias("id_sum"))


@query(
    "source_series_csv",
    sql(f"SELECT stream, i, {ts('ts')} AS ts, {r6('value')} AS value, label FROM serl WHERE metric = 0", "serl"),
)
def source_series_csv(spark, sf_dir):
    """Every stream written as CSV files of its own folder, read back and labelled."""
    work = _work(spark)
    one = series(spark, sf_dir).where("metric = 0")
    stamped = one.select("stream", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"), "value")
    stamped.write.partitionBy("stream").option("header", True).csv(f"{work}/series")
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"stream=([^/]+)", 1)
    back = readers.read_series_csv(spark, f"{work}/series", folder)
    return label_points(back, stream_spans(spark, sf_dir)).select("stream", "i", "ts", "value", "label")


@query(
    "source_label_map",
    sql(f"SELECT stream, {ts('span_start')} AS span_start, {ts('span_end')} AS span_end FROM spans", "spans"),
)
def source_label_map(spark, sf_dir):
    """The label spans written as one JSON map of stream file to intervals, read back."""
    work = _work(spark)
    clock = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    spans = stream_spans(spark, sf_dir).groupBy("stream").agg(F.collect_list(F.array(clock("span_start"), clock("span_end"))).alias("s"))
    name = F.concat(F.lit("folder/"), "stream", F.lit(".csv"))
    whole = spans.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(name, "s")))).alias("value"))  # twenty streams
    whole.write.text(f"{work}/labels")
    return readers.read_label_spans(spark, f"{work}/labels")


_BY_MINUTE = "TIMESTAMP '2024-01-01' + to_minutes(i)"


@query(
    "source_matrix",
    sql(f"SELECT stream, i, {ts(_BY_MINUTE)} AS ts, CAST(metric AS INT) AS metric, {r6('value')} AS value, label FROM serl", "serl"),
)
def source_matrix(spark, sf_dir):
    """Every stream as a matrix file of two metrics and a label file, read back with a minute per line."""
    work = _work(spark)
    rows = labelled_series(spark, sf_dir).groupBy("stream", "i").agg(
        F.max(F.when(F.col("metric") == 0, F.col("value"))).alias("v0"), F.max(F.when(F.col("metric") == 1, F.col("value"))).alias("v1"),
        F.max("label").alias("label"),
    )
    rows = rows.repartition("stream").sortWithinPartitions("stream", "i")
    for name, line in (("data", F.concat_ws(",", "v0", "v1")), ("labels", F.col("label").cast("string"))):
        rows.select("stream", line.alias("value")).write.partitionBy("stream").text(f"{work}/{name}")
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"stream=([^/]+)", 1)
    return readers.read_matrix_series(spark, f"{work}/data", f"{work}/labels", datetime(2024, 1, 1), folder)


@query("model_round_trip", sql(f"SELECT {ts('window_start')} AS window_start, true AS same FROM feat", "feat"))
def model_round_trip(spark, sf_dir):
    """A model saved as four tables and loaded again scores the same."""
    work = _work(spark)
    rows = feature_table(spark, sf_dir)
    model = forest.fit(rows, "window_start", threshold=0.0, trained_at=as_of(spark, sf_dir))
    model.save(f"{work}/model")
    before = forest.score(rows, model).select("window_start", F.col("score").alias("before"))
    after = forest.score(rows, forest.Forest.load(spark, f"{work}/model")).select("window_start", "score")
    return before.join(after, "window_start").select("window_start", (F.col("before") == F.col("score")).alias("same"))
