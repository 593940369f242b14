"""Readers and sinks over small files."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vigilspark.operators.series import label_points
from vigilspark.sources import readers, writers

T0 = datetime(2024, 1, 1)


def test_event_log(spark, tmp_path):
    lines = [{"time": "2024-01-01T00:00:00", "service": "a"}, {"timestamp": "2024-01-01T01:00:00+00:00", "service": "b", "metadata": {"x": 1}}, {"time": "2024-01-02T00:00:00Z"}]
    (tmp_path / "log.jsonl").write_text("\n\n".join(json.dumps(x) for x in lines) + "\n")
    got = readers.read_event_log(spark, str(tmp_path / "log.jsonl"), T0, T0 + timedelta(days=1)).orderBy("time").collect()
    assert [(r["service"], r["time"]) for r in got] == [("a", T0), ("b", T0 + timedelta(hours=1))]
    assert json.loads(got[1]["metadata"]) == {"x": 1}


def test_unreadable_log_lines_are_kept_apart(spark, tmp_path):
    good = json.dumps({"time": "2024-01-01T00:00:00", "service": "a"})
    bad_time = json.dumps({"time": "yesterday", "service": "b"})
    (tmp_path / "log.jsonl").write_text(f'{good}\n{{"time": "2024-01-01T0\n\n{bad_time}\n')
    path = str(tmp_path / "log.jsonl")
    assert readers.read_event_log(spark, path, T0, T0 + timedelta(days=1)).count() == 1
    lost = {(r.raw, r.reason) for r in readers.unread_event_log(spark, path).collect()}
    assert lost == {('{"time": "2024-01-01T0', "unreadable line"), (bad_time, "unreadable time")}


def test_timeline_file(spark, tmp_path):
    doc = {"start_utc": "x", "scenarios": [{"type": "b", "targets": ["s"], "start_utc": "2024-01-01T00:00:00Z", "end_utc": "2024-01-01T00:05:00+00:00", "effect": {"z": 1}},
                                           {"type": "a", "start_utc": "2024-01-01T01:00:00", "end_utc": "2024-01-01T02:00:00"}]}
    (tmp_path / "t.json").write_text(json.dumps(doc, indent=2))
    got = readers.read_timeline(spark, str(tmp_path / "t.json")).orderBy("scenario_id").collect()
    assert [(r["scenario_id"], r["type"], r["start_ts"]) for r in got] == [(0, "b", T0), (1, "a", T0 + timedelta(hours=1))]


def test_feature_csv_keeps_known_columns_in_order(spark, tmp_path):
    (tmp_path / "f.csv").write_text("error_rate,other,event_count\n0.5,x,10\n")
    df = readers.read_feature_csv(spark, str(tmp_path / "f.csv"))
    assert df.columns == ["event_count", "error_rate"] and df.first()["event_count"] == 10.0
    (tmp_path / "g.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError):
        readers.read_feature_csv(spark, str(tmp_path / "g.csv"))


def test_series_csv_with_label_spans(spark, tmp_path):
    for name, n in (("cpu", 5), ("disk", 3)):
        rows = [f"{(T0 + timedelta(minutes=5 * i)):%Y-%m-%d %H:%M:%S},{i * 1.5}" for i in range(n)]
        (tmp_path / f"{name}.csv").write_text("timestamp,value\n" + "\n".join(rows) + "\n")
    (tmp_path / "labels.json").write_text(json.dumps({"group/cpu.csv": [["2024-01-01 00:05:00.000000", "2024-01-01 00:10:00.000000"]], "group/disk.csv": []}))
    series = readers.read_series_csv(spark, str(tmp_path / "*.csv"))
    spans = readers.read_label_spans(spark, str(tmp_path / "labels.json"))
    got = {(r["stream"], r["i"]): r["label"] for r in label_points(series, spans).collect()}
    assert got == {("cpu", 0): 0, ("cpu", 1): 1, ("cpu", 2): 1, ("cpu", 3): 0, ("cpu", 4): 0, ("disk", 0): 0, ("disk", 1): 0, ("disk", 2): 0}


def test_numbered_lines_across_file_splits(spark, tmp_path):
    (tmp_path / "m.txt").write_text("\n".join(f"{i},{i * 2}" for i in range(2000)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = readers.read_numbered_lines(spark, str(tmp_path / "m.txt"))
        assert spark.read.text(str(tmp_path / "m.txt")).rdd.getNumPartitions() > 4
        got = lines.where(F.col("i") != F.split("line", ",")[0].cast("long")).count()
        assert got == 0 and lines.count() == 2000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_matrix_series_cut_to_the_shorter(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "l").mkdir()
    (tmp_path / "d" / "machine-1.txt").write_text("0.1,0.2\n0.3,0.4\n0.5,0.6\n")
    (tmp_path / "l" / "machine-1.txt").write_text("0\n1\n")
    got = readers.read_matrix_series(spark, str(tmp_path / "d"), str(tmp_path / "l"), T0).orderBy("i", "metric").collect()
    assert [(r["i"], r["metric"], r["value"], r["label"]) for r in got] == [(0, 0, 0.1, 0), (0, 1, 0.2, 0), (1, 0, 0.3, 1), (1, 1, 0.4, 1)]
    assert got[2]["ts"] == T0 + timedelta(minutes=1)


def test_event_table_prunes_by_date(spark, tmp_path):
    rows = [(T0 + timedelta(hours=i), "s", i) for i in range(72)]
    writers.write_events(spark.createDataFrame(rows, "time timestamp, service string, n int"), str(tmp_path / "e"))
    day = readers.scan_events(spark, str(tmp_path / "e"), T0 + timedelta(days=1), T0 + timedelta(days=2))
    assert sorted(r["n"] for r in day.collect()) == list(range(24, 48))
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "event_date" in plan.split("PartitionFilters:")[1].split("]")[0] and "GreaterThanOrEqual(time" in plan


def test_retention_drops_whole_partitions(spark, tmp_path):
    rows = spark.createDataFrame([(T0 + timedelta(days=i), i) for i in range(5)], "time timestamp, n int")
    spark.sql("DROP TABLE IF EXISTS kept_events")
    writers.with_event_date(rows).write.partitionBy("event_date").option("path", str(tmp_path / "t")).saveAsTable("kept_events")
    gone = writers.drop_old_partitions(spark, "kept_events", T0 + timedelta(days=4), 2)
    assert [d.day for d in gone] == [1, 2]
    assert sorted(r["n"] for r in spark.table("kept_events").collect()) == [2, 3, 4]
    spark.sql("DROP TABLE kept_events")


def test_compaction_layout(spark):
    rows = spark.createDataFrame([(T0 + timedelta(minutes=i), f"s{i % 3}", "INFO") for i in range(300)], "time timestamp, service string, level string")
    out = writers.compacted(rows, T0 + timedelta(days=10), 7)
    assert out.count() == 300
    assert writers.compacted(rows, T0 + timedelta(days=3), 7).count() == 0


def test_upsert_rewrites_touched_dates_only(spark, tmp_path):
    """Replaced, added and moved reports; files of other dates keep their names, a date left empty goes."""
    from vigilspark.sources import writers

    path = str(tmp_path / "reports")
    writers.upsert_reports(spark.createDataFrame([("x", T0, "1")], "report_id string, generated_at timestamp, content string"), f"{path}-new")
    assert spark.read.parquet(f"{path}-new").count() == 1  # a table that isn't there yet
    day = lambda d: T0 + timedelta(days=d)
    schema = "report_id string, generated_at timestamp, content string"
    old = [("a", day(0), "1"), ("b", day(0), "1"), ("c", day(1), "1"), ("d", day(2), "1"), ("e", day(4), "1")]
    writers.write_reports(spark.createDataFrame(old, schema), path)
    files = lambda: {str(f.relative_to(path)) for f in (tmp_path / "reports").rglob("*.parquet")}
    before = files()
    new = [("a", day(0), "2", 7), ("d", day(3), "2", 7), ("f", day(3), "2", 7), ("f", day(2), "older", 7)]
    writers.upsert_reports(spark.createDataFrame(new, schema + ", tokens int"), path)
    got = {(r["report_id"], r["generated_at"], r["content"], r["tokens"]) for r in spark.read.option("mergeSchema", True).parquet(path).collect()}
    assert got == {("a", day(0), "2", 7), ("b", day(0), "1", None), ("c", day(1), "1", None), ("d", day(3), "2", 7), ("e", day(4), "1", None), ("f", day(3), "2", 7)}
    untouched = {f for f in before if f.startswith(("event_date=2024-01-02", "event_date=2024-01-05"))}
    assert len(untouched) == 2 and untouched <= files() and not any(f.startswith("event_date=2024-01-03") for f in files())


def test_upsert_into_a_table_without_rows(spark, tmp_path):
    path, schema = str(tmp_path / "reports"), "report_id string, generated_at timestamp, content string"
    none = spark.createDataFrame([], schema)
    writers.write_reports(none, path)
    writers.upsert_reports(none, path)
    writers.upsert_reports(spark.createDataFrame([("a", T0, "1")], schema), path)
    writers.upsert_reports(none, path)
    assert [r["content"] for r in spark.read.parquet(path).collect()] == ["1"]


EVENT_ROWS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
ANOMALY_QUERIES = ["sink_anomalies", "sink_documents", "sink_report_upsert", "stream_context"]


@pytest.mark.parametrize("name", sorted(ANOMALY_QUERIES))
def test_no_anomalies_give_no_rows(spark, tmp_path, name):
    """Tables of a time without anomalies are written without rows, and read back as such; then some come."""
    from vigilspark.catalog import QUERIES

    def events(folder, kind):
        rows = [(i, T0 + timedelta(minutes=i), 7 * i, kind(i), 10.0 + i, '{"k": 3}') for i in range(60)]
        spark.createDataFrame(rows, EVENT_ROWS).write.parquet(f"{tmp_path}/{folder}/events.parquet")
        return QUERIES[name](spark, f"{tmp_path}/{folder}")

    quiet = events("quiet", lambda i: "click")
    assert quiet.collect() == [] and quiet.columns
    assert events("loud", lambda i: "error" if i % 3 else "click").count() > 0
