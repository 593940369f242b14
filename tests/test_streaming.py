"""Streams against their batch twins: restarts, late events, redelivery and state across batches."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vigilspark.functions.scalars import with_metadata_fields
from vigilspark.operators import detection
from vigilspark.operators.features import window_features
from vigilspark.operators.rollups import rollup
from vigilspark.operators.windows import event_checks, trailing_buffer
from vigilspark.plans.cooldown import cooldown_kept
from vigilspark.sources.readers import event_stream
from vigilspark.schema import EVENT, FEATURE_NAMES
from vigilspark.session import materialize
from vigilspark.streaming import jobs, stateful

T0 = datetime(2024, 1, 1)
EVENTS = "time timestamp, service string, level string, message string, metadata string, trace_id string, span_id string, event_id long"


def frame(spark, seconds, service="s"):
    rows = [
        (T0 + timedelta(seconds=s), service, "ERROR" if i % 4 == 0 else "INFO", "m", json.dumps({"latency_ms": 1 + i % 5, "endpoint": f"/e{i % 3}"}), f"t{s}", f"p{i}", i)
        for i, s in enumerate(seconds)
    ]
    return spark.createDataFrame(rows, EVENTS)


def feed(spark, parts, folder, start):
    """Append each part and let the job catch up; later runs resume from the checkpoint."""
    for part in parts:
        part.write.mode("append").parquet(folder)
        start(jobs.table_stream(spark, folder, part.schema)).awaitTermination()


def _rows(df, columns):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in df.select(*columns).collect())


def test_rollup_is_revised_until_the_start_offset(spark, tmp_path):
    """Buckets are there once the end offset has passed; an event of a written bucket is folded in if it comes within
    the start offset, and one that comes later is not."""
    first = [frame(spark, range(0, 600, 7)), frame(spark, range(600, 1200, 7))]
    revises = frame(spark, [800])  # 400 s behind, its bucket is written
    too_late = frame(spark, [30])  # 1170 s behind
    out = str(tmp_path / "out")
    job = lambda s: jobs.rollup_job(s, "1 minute", out, str(tmp_path / "state"), str(tmp_path / "ck"))
    feed(spark, first, str(tmp_path / "in"), job)
    whole = first[0].unionByName(first[1])
    newest = 1_196  # the last event; buckets that end by one minute before it are closed
    want = rollup(with_metadata_fields(whole), "1 minute")
    closed = lambda df, last: df.where(F.col("bucket") <= F.lit(T0 + timedelta(seconds=last - 120)))
    assert _rows(jobs.rollup_table(spark, out), want.columns) == _rows(closed(want, newest), want.columns)
    feed(spark, [revises, too_late, frame(spark, [5_000])], str(tmp_path / "in"), job)
    want = closed(rollup(with_metadata_fields(whole.unionByName(revises)), "1 minute"), 5_000)
    assert _rows(jobs.rollup_table(spark, out), want.columns) == _rows(want, want.columns)


def test_replayed_batch_does_not_duplicate(spark, tmp_path):
    df = frame(spark, range(20))
    for _ in range(2):
        jobs.save_batch(df, str(tmp_path / "t"), 3)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 20


@pytest.fixture(scope="module")
def stateful_spark(spark):
    session = stateful.stateful_session(spark)
    session.conf.set("spark.sql.shuffle.partitions", "2")
    return session


@pytest.mark.parametrize("size", [5, 1000])
def test_trailing_buffer_across_restarts(spark, stateful_spark, tmp_path, size):
    """Two services, a silence, and an event at the instant of a check; every run resumes from the checkpoint."""
    parts = [frame(spark, [*range(0, 300, 3), 99], "a").unionByName(frame(spark, range(5, 290, 40), "b").withColumn("event_id", F.col("event_id") + 500)),
             frame(spark, range(300, 310, 2), "a"), frame(spark, range(900, 1200, 11), "a").unionByName(frame(spark, [2000, 2101], "b").withColumn("event_id", F.col("event_id") + 500))]
    parts = [p.withColumn("event_id", F.col("event_id") + 1000 * k).select("event_id", "time", "service", "level") for k, p in enumerate(parts)]
    job = lambda s: jobs.trailing_buffer_job(s, str(tmp_path / "out"), str(tmp_path / "ck"), 100, size)
    feed(stateful_spark, parts, str(tmp_path / "in"), job)
    events = parts[0].unionByName(parts[1]).unionByName(parts[2])
    want = trailing_buffer(events, event_checks(events, 100), size)
    key = lambda df: sorted((r["service"], r["tick"], r["event_id"], r["age"], r["time"], r["level"]) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(want) and want.count() > 10


def test_detection_across_restarts(spark, stateful_spark, tmp_path):
    """The stream keeps and suppresses the same alerts as the batch, per service; state holds the newest events only."""
    parts = [frame(spark, range(k * 1000, k * 1000 + 990, 3), "payment-service").withColumn("event_id", F.col("event_id") + 10_000 * k) for k in range(2)]
    parts = [p.unionByName(frame(spark, range(k * 1000, k * 1000 + 900, 200), "quiet").withColumn("event_id", F.col("event_id") + 10_000 * k + 5_000)) for k, p in enumerate(parts)]
    parts = [with_metadata_fields(p).select("event_id", "time", "service", "level", "valid_latency") for p in parts]
    out = {n: str(tmp_path / n) for n in ("checks", "anomalies", "alerts")}
    sink = jobs.detection_sink(out["checks"], out["anomalies"], out["alerts"])
    job = lambda s: jobs.detection_job(s, detection.RuleJudge(-0.1), sink, str(tmp_path / "ck"), 60, 40, 200)
    feed(stateful_spark, parts, str(tmp_path / "in"), job)
    events = parts[0].unionByName(parts[1])
    want = materialize(detection.detections(events, 60, 40, 10, 200, threshold=-0.1))
    columns = ["service", "tick", "window_size", "window_start", "window_end", "score", "is_anomaly", "kept", "error_rate", "p95_latency_ms", "payment-service_p95_latency"]
    names = [f"`{c}`" for c in columns]
    got = spark.read.parquet(out["checks"])
    assert _rows(got, names) == _rows(want, names)
    kept = {r["anomaly_id"] for r in want.where("kept").collect()}
    assert len(kept) > 4 and want.where("is_anomaly AND NOT kept").count() > 4 and want.agg(F.min("window_size")).first()[0] == 10
    assert {r["anomaly_id"] for r in spark.read.parquet(out["anomalies"]).collect()} == kept
    assert spark.read.json(out["alerts"]).count() == len(kept)


def test_window_vector_equals_the_feature_columns(spark):
    """The streaming features of a window are those of the batch plan."""
    events = with_metadata_fields(frame(spark, range(0, 90, 2), "auth-service").unionByName(frame(spark, range(40), "other")))
    rows = events.select("service", "level", "valid_latency", F.lit(1).alias("w"))
    want = window_features(rows, ["w"]).first()
    vector = detection.window_vector(rows.toPandas())
    assert [round(x, 9) for x in vector] == [round(want[n], 9) for n in FEATURE_NAMES]


def test_cooldown_state_spans_batches(spark, tmp_path):
    seconds = [0, 60, 119, 121, 200, 239, 241, 242, 400, 500, 521, 700]
    rows = spark.createDataFrame([("s", T0 + timedelta(seconds=x), f"a{x:04d}") for x in seconds], "service string, time timestamp, anomaly_id string")
    parts = [rows.where(F.col("time") < F.lit(T0 + timedelta(seconds=130))), rows.where(F.col("time").between(F.lit(T0 + timedelta(seconds=130)), F.lit(T0 + timedelta(seconds=240)))),
             rows.where(F.col("time") > F.lit(T0 + timedelta(seconds=240)))]
    job = lambda s: jobs.cooldown_job(s, str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "ck"))
    feed(spark, parts, str(tmp_path / "in"), job)
    got = sorted(r["anomaly_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(r["anomaly_id"] for r in cooldown_kept(rows, ["service"], "time", "anomaly_id", 120).collect())


def test_ingest_from_json_lines(spark, tmp_path):
    good = {"timestamp": "2024-01-01T00:00:00Z", "service": "s", "level": "INFO", "message": "m", "metadata": {"latency_ms": 3}}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(json.dumps(good) + "\nbroken\n")
    (tmp_path / "in" / "b.jsonl").write_text(json.dumps({**good, "level": "LOUD"}) + "\n" + json.dumps(good) + "\n")
    job = jobs.ingest_job(event_stream(spark, str(tmp_path / "in")), str(tmp_path / "ev"), str(tmp_path / "bad"), str(tmp_path / "ck"), "h1")
    job.awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "ev")).collect()
    assert len(stored) == 2 and all(r["host"] == "h1" and r["ingested_at"] is not None for r in stored)
    assert len({r["event_id"] for r in stored}) == 1 and {(r["has_latency"], r["valid_latency"]) for r in stored} == {(True, 3.0)}  # sent twice
    typed = jobs.table_stream(spark, str(tmp_path / "ev"))
    assert set(EVENT.names) <= set(typed.columns) and detection.check_windows(spark.read.schema(EVENT).parquet(str(tmp_path / "ev")), 60).count() == 0
    assert sorted(r["status"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == ["unmarshal_error", "validation_error"]


def test_redelivered_events_count_once(spark, tmp_path):
    part = frame(spark, range(0, 100, 2))
    job = lambda s: jobs.run(jobs.deduplicated(s), lambda b, i: jobs.save_batch(b, str(tmp_path / "out"), i), str(tmp_path / "ck"))
    feed(spark, [part, part], str(tmp_path / "in"), job)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50


def test_events_without_ids_are_not_one_event(spark, tmp_path):
    """Distinct events with null ids all stay; redelivered ones count once, with or without ids."""
    part = frame(spark, range(0, 100, 2)).withColumn("trace_id", F.lit(None).cast("string"))
    job = lambda s: jobs.run(jobs.deduplicated(s), lambda b, i: jobs.save_batch(b, str(tmp_path / "out"), i), str(tmp_path / "ck"))
    feed(spark, [part, part], str(tmp_path / "in"), job)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50
