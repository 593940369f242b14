"""Literal-row tests of operators: the value traps, validation cases, severity, reports and suppression."""

import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilspark.functions.scalars import iso_timestamp, with_metadata_fields
from vigilspark.operators import alerts, drift, evaluation, features, listing, reports, rollups, validation, windows
from vigilspark.operators import series as series_ops
from vigilspark.schema import FEATURE_NAMES, KNOWN_SERVICES, service_columns

T0 = datetime(2024, 1, 1)


def events(spark, rows):
    """(seconds, service, level, metadata) rows."""
    data = [(T0 + timedelta(seconds=s), svc, lvl, "m", meta) for s, svc, lvl, meta in rows]
    return spark.createDataFrame(data, "time timestamp, service string, level string, message string, metadata string")


def one_window(spark, rows, min_events=10):
    df = with_metadata_fields(events(spark, rows)).withColumn("window_start", F.lit(T0)).withColumn("window_end", F.lit(T0 + timedelta(hours=1)))
    return features.window_features(df, min_events=min_events).collect()


def meta(latency):
    return json.dumps({"latency_ms": latency, "endpoint": "/x"})


def test_feature_contract():
    assert len(FEATURE_NAMES) == 27 and FEATURE_NAMES[1] == "error_rate" and FEATURE_NAMES[11] == "api-gateway_error_rate"


def test_metadata_number_types(spark):
    cases = ['{"latency_ms": 12.5}', '{"latency_ms": "12.5"}', '{"latency_ms": true}', '{"latency_ms": null}', '{"a": 1}', '{"latency_ms": -3}',
             '{"latency_ms": 0}', '{"latency_ms": "fast"}', "{bad", None]
    got = [tuple(r)[1:4] for r in with_metadata_fields(spark.createDataFrame([(c,) for c in cases], "metadata string")).collect()]
    assert got == [(True, 12.5, 12.5), (True, 12.5, None), (True, None, 1.0), (True, None, None), (False, None, None),
                   (True, -3.0, None), (True, 0.0, None), (True, None, None), (False, None, None), (False, None, None)]


def test_features_error_rate_and_percentiles(spark):
    rows = [(i, "api-gateway", "ERROR" if i < 5 else "INFO", meta(500 if i < 5 else 100)) for i in range(20)]
    got = one_window(spark, rows)[0]
    assert got["event_count"] == 20 and got["error_rate"] == 0.25 and got["p50_latency_ms"] == 100
    values = [500] * 5 + [100] * 15
    assert np.isclose(got["p95_latency_ms"], np.percentile(values, 95)) and np.isclose(got["latency_std"], np.std(values))
    assert np.isclose(got["log_error_rate"], np.log1p(250)) and np.isclose(got["error_count"], 5)
    assert got["p50_latency_ms"] <= got["p95_latency_ms"] <= got["p99_latency_ms"]


def test_features_too_few_events_and_null_metadata(spark):
    assert one_window(spark, [(i, "a", "INFO", None) for i in range(5)]) == []
    got = one_window(spark, [(i, "a", "INFO", None) for i in range(15)])[0]
    assert got["p95_latency_ms"] == 0.0 and got["latency_std"] == 0.0 and got["event_count"] == 15


def test_features_isolate_services(spark):
    rows = [(i, "payment-service", "ERROR" if i < 2 else "INFO", meta(50)) for i in range(10)]
    rows += [(i, "api-gateway", "INFO", meta(50)) for i in range(90)]
    got = one_window(spark, rows)[0]
    assert np.isclose(got["error_rate"], 0.02)
    assert np.isclose(got["payment-service_error_rate"], 0.2) and got["api-gateway_error_rate"] == 0.0
    for s in KNOWN_SERVICES:
        if s not in ("payment-service", "api-gateway"):
            assert got[service_columns(s)[0]] == 0.0 and got[service_columns(s)[1]] == 0.0


def test_features_critical_counts_as_error_but_rollup_separates(spark):
    rows = [(i, "api-gateway", "CRITICAL" if i < 3 else "INFO", meta(10)) for i in range(15)]
    assert np.isclose(one_window(spark, rows)[0]["error_rate"], 0.2)
    roll = rollups.rollup(with_metadata_fields(events(spark, rows)), "1 hour").first()
    assert roll["error_rate"] == 0.0 and np.isclose(roll["critical_rate"], 0.2)


def test_rollup_drops_events_without_latency_key_but_keeps_null(spark):
    rows = [(0, "a", "INFO", meta(10)), (1, "a", "INFO", '{"latency_ms": null}'), (2, "a", "INFO", '{"x": 1}'), (3, "a", "INFO", meta(30))]
    got = rollups.rollup(with_metadata_fields(events(spark, rows)), "1 minute").first()
    assert got["event_count"] == 3 and got["avg_latency"] == 20.0 and np.isclose(got["latency_stddev"], np.std([10, 30], ddof=1))
    assert got["unique_endpoints"] == 1


def test_weighted_rollup_and_features_equal_plain(spark):
    rng = np.random.default_rng(2)
    rows = [(int(s), "search-service", "ERROR" if s % 7 == 0 else "INFO", meta(int(v))) for s, v in zip(range(300), rng.integers(1, 9, 300))]
    plain = with_metadata_fields(events(spark, rows))
    cells = plain.groupBy(F.date_trunc("hour", "time").alias("time"), "service", "level", "latency_ms", "valid_latency", "endpoint", "has_latency").agg(F.count("*").alias("n"))
    a, b = rollups.rollup(plain, "1 hour").first(), rollups.rollup(cells, "1 hour", "n").first()
    assert all(np.isclose(x, y) if isinstance(x, float) else x == y for x, y in zip(a, b))
    keyed = lambda d: d.withColumn("window_start", F.lit(T0)).withColumn("window_end", F.lit(T0))
    c, d = features.window_features(keyed(plain)).first(), features.window_features(keyed(cells), weight="n").first()
    assert np.allclose(c[2:], d[2:])


@pytest.mark.parametrize("score,rate,want", [(-1.5, 0.6, "critical"), (-0.9, 0.4, "high"), (-0.75, 0.2, "medium"), (-0.5, 0.05, "low"), (0.0, 0.5, "high")])
def test_severity(spark, score, rate, want):
    assert spark.range(1).select(alerts.severity(F.lit(score), F.lit(rate))).first()[0] == want


def test_ingest_cases(spark):
    good = {"timestamp": "2024-01-01T00:00:00Z", "service": "s", "level": "ERROR", "message": "m", "metadata": {"a": {"b": 1}}}
    lines = [json.dumps(good), "not json", json.dumps({**good, "service": ""}), json.dumps({**good, "level": "LOUD"}),
             json.dumps({k: v for k, v in good.items() if k != "timestamp"}), json.dumps({**good, "timestamp": "soon"}),
             json.dumps({**good, "service": "x" * 256}), json.dumps(good)[:30]]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, raw string")
    got = {r["i"]: (r["status"], list(r["errors"])) for r in validation.parse_json_events(df).collect()}
    assert got[0] == ("accepted", [])
    assert got[1][0] == got[5][0] == got[7][0] == "unmarshal_error"
    assert got[2][1] == ["service_required"] and got[3][1] == ["level_invalid"]
    assert got[4][1] == ["timestamp_required"] and got[6][1] == ["service_too_long"]
    assert json.loads(validation.parse_json_events(df).where("i = 0").first()["metadata"]) == {"a": {"b": 1}}


def test_batches_are_all_or_nothing(spark):
    ok, bad = (T0, "s", "INFO", "m"), (T0, "s", "LOUD", "m")
    data = [(0, [ok, ok]), (1, [ok, bad]), (2, []), (3, None), (4, [ok] * 1001), (5, [ok] * 1000)]
    df = spark.createDataFrame(data, "b int, events array<struct<time:timestamp,service:string,level:string,message:string>>")
    done = validation.validate_batches(df)
    assert {r["b"]: r["batch_accepted"] for r in done.collect()} == {0: True, 1: False, 2: False, 3: False, 4: False, 5: True}
    assert validation.batch_events(done).count() == 1002


def test_iso_times(spark):
    texts = ["2024-01-01T00:00:00Z", "2024-01-01T02:00:00+02:00", "2024-01-01T00:00:00", "2024-01-01 00:00:00.5", "nope"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(iso_timestamp("t")).collect()]
    assert got == [T0, T0, T0, T0 + timedelta(microseconds=500_000), None]


def test_windows_align_to_the_timeline_and_keep_empty_ones(spark):
    start, end = T0 + timedelta(seconds=17), T0 + timedelta(seconds=17 + 300)
    rows = events(spark, [(10, "a", "INFO", None), (17, "a", "INFO", None), (80, "a", "INFO", None), (316, "a", "INFO", None), (317, "a", "INFO", None)])
    got = [(int((r[0] - start).total_seconds()), r[2]) for r in windows.counted_windows(rows, start, end, 60, 30).orderBy("window_start").collect()]
    assert [g[0] for g in got] == list(range(0, 241, 30))
    assert dict(got) == {0: 1, 30: 1, 60: 1, 90: 0, 120: 0, 150: 0, 180: 0, 210: 0, 240: 1}


def test_label_bounds_are_strict_and_first_scenario_wins(spark):
    w = spark.createDataFrame([(T0 + timedelta(minutes=10 * i), T0 + timedelta(minutes=10 * i + 10)) for i in range(4)], "window_start timestamp, window_end timestamp")
    s = spark.createDataFrame([(2, "b", T0 + timedelta(minutes=10), T0 + timedelta(minutes=25)), (1, "a", T0 + timedelta(minutes=20), T0 + timedelta(minutes=30))],
                              "scenario_id int, type string, start_ts timestamp, end_ts timestamp")
    got = [(r["label"], r["scenario_type"]) for r in windows.label_windows(w, s, 600).orderBy("window_start").collect()]
    assert got == [(0, None), (1, "b"), (1, "a"), (0, None)]


@pytest.mark.parametrize("n,want", [(1, (1, 0, 0)), (2, (1, 0, 1)), (3, (1, 1, 1)), (10, (6, 2, 2)), (100, (60, 20, 20))])
def test_split_floors_and_rescue(spark, n, want):
    w = spark.createDataFrame([(T0 + timedelta(hours=i),) for i in range(n)], "window_start timestamp")
    got = {r["split"]: r["count"] for r in windows.temporal_split(w, 0.6, 0.2).groupBy("split").count().collect()}
    assert tuple(got.get(k, 0) for k in ("train", "val", "test")) == want


def test_confusion_and_mcc(spark):
    rows = [(-0.5, 1)] * 16 + [(0.5, 1)] * 3 + [(0.5, 0)] * 42
    got = evaluation.confusion(spark.createDataFrame(rows, "score double, label int"), 6.17e-16).first()
    assert (got["tp"], got["fp"], got["tn"], got["fn"]) == (16, 0, 42, 3)
    assert np.isclose(got["f1"], 0.914, atol=5e-4) and np.isclose(got["f2"], 0.870, atol=5e-4)
    assert np.isclose(got["mcc"], 0.887, atol=5e-4) and np.isclose(got["balanced_accuracy"], 0.921, atol=5e-4)


def test_threshold_is_strict_and_grid_is_accumulated(spark):
    grid = evaluation.threshold_grid()
    assert len(grid) == 76 and 0 < grid[50] < 1e-14
    rows = spark.createDataFrame([(grid[3], 1), (0.3, 0)], "score double, label int")
    swept = {r["threshold"]: r["tp"] for r in evaluation.threshold_sweep(rows).collect()}
    assert swept[grid[3]] == 0 and swept[grid[4]] == 1
    assert evaluation.best_threshold(evaluation.threshold_sweep(rows)).first()["threshold"] == grid[4]


def test_areas_match_pairwise_definition_and_one_class_is_null(spark):
    rng = np.random.default_rng(4)
    rows = [(float(round(s, 1)), int(y)) for s, y in zip(rng.normal(0, 1, 300), rng.integers(0, 2, 300))]
    df = spark.createDataFrame(rows, "score double, label int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = np.mean([(p < n) + 0.5 * (p == n) for p in pos for n in neg])
    assert np.isclose(evaluation.roc_auc(df).first()[0], want)
    tp = fp = ap = 0
    for s in sorted({s for s, _ in rows}):
        step = sum(1 for p in pos if p == s)
        tp, fp = tp + step, fp + sum(1 for n in neg if n == s)
        ap += step / len(pos) * tp / (tp + fp)
    assert np.isclose(evaluation.pr_auc(df).first()[0], ap)
    single = spark.createDataFrame([(0.1, 1), (0.2, 1)], "score double, label int")
    assert evaluation.roc_auc(single).first()[0] is None and evaluation.pr_auc(single).first()[0] is None


def test_psi_constant_feature_and_outside_values(spark):
    ref = spark.createDataFrame([("c", 5.0)] * 20 + [("u", float(i)) for i in range(100)], "feature string, value double")
    cur = spark.createDataFrame([("c", 5.0)] * 10 + [("u", float(i + 1000)) for i in range(50)], "feature string, value double")
    edges = {r["feature"]: r["edges"] for r in drift.quantile_edges(ref).collect()}
    assert all(b > a for a, b in zip(edges["c"], edges["c"][1:])) and np.isclose(edges["c"][10], 5.0 + 1e-8)
    got = {r["feature"]: (r["psi"], r["severity"]) for r in drift.psi(ref, cur).collect()}
    assert np.isclose(got["c"][0], 0.0) and got["c"][1] == "ok" and got["u"][1] == "major"
    p = np.full(10, 0.1) + 1e-6
    q = np.array([0.0] * 9 + [1.0]) + 1e-6
    assert np.isclose(got["u"][0], np.sum((q - p) * np.log(q / p)))


def test_series_windows_zscore_and_partial_tail(spark):
    rows = [("s", i, T0 + timedelta(minutes=i), 0, float(i % 7), int(i == 64)) for i in range(100)] + [("short", i, T0, 0, 1.0, 0) for i in range(59)]
    df = spark.createDataFrame(rows, "stream string, i long, ts timestamp, metric int, value double, label int")
    z = series_ops.zscore(df)
    out = series_ops.series_features(z, series_ops.value_cutoff(z)).orderBy("wid").collect()
    assert [(r["stream"], r["wid"], r["label"]) for r in out] == [("s", 0, 0), ("s", 1, 1)]
    values = np.array([i % 7 for i in range(100)], float)
    norm = (values - values.mean()) / values.std()
    assert np.isclose(out[0]["p95_latency_ms"], np.percentile(norm[:60], 95)) and np.isclose(out[1]["latency_std"], norm[30:90].std())


def test_report_cost_and_unknown_model(spark):
    df = spark.createDataFrame([("claude-3-5-sonnet-20241022", 1000, 500), ("mystery", 1000, 500)], "model string, input_tokens int, output_tokens int")
    got = {r["model"]: (r["cost_usd"], r["price_is_default"]) for r in reports.report_cost(df).collect()}
    assert got["claude-3-5-sonnet-20241022"] == (0.0105, False)
    assert got["mystery"] == (0.000225, True)


def test_response_parsing_and_markdown(spark):
    body = {"incident_id": "i1", "service": "s", "detected_at": "now", "severity": "HIGH", "confidence": 0.8, "executive_summary": "e",
            "root_cause_hypothesis": "r", "contributing_features": [{"name": "error_rate", "value": 0.5, "shap": -1.25, "direction": "toward_anomaly"}],
            "recommended_actions": [{"timeframe": "long_term", "action": "B", "rationale": "y"}, {"timeframe": "immediate", "action": "A", "rationale": "x"}],
            "monitoring_checks": ["m1"]}
    texts = [json.dumps(body), "```json\n" + json.dumps(body) + "\n```", "no json " + "x" * 2000, "", json.dumps({**body, "severity": "INFO"})]
    df = spark.createDataFrame([("id", "svc", "t", "critical", t) for t in texts], "incident_id string, service string, detected_at string, severity string, response string")
    got = [(r["parsed_ok"], r["report"]) for r in reports.parse_responses(df).collect()]
    assert [g[0] for g in got] == [True, True, False, False, False]
    assert got[2][1]["severity"] == "CRITICAL" and len(got[2][1]["executive_summary"]) == 1000 and got[2][1]["confidence"] == 0.5
    assert got[3][1]["executive_summary"] == reports.FALLBACK_EMPTY
    text = reports.report_markdown(reports.parse_responses(df), T0).first()["markdown"]
    assert text.index("### Immediate") < text.index("### Long Term") and "| `error_rate` | 0.500 | -1.250 | toward_anomaly |" in text


def test_inhibition_only_while_the_critical_alert_fires(spark):
    """A morning warning stays whatever fires in the evening; the end of a span doesn't count; other services don't."""
    at = lambda h, m=0: T0 + timedelta(hours=h, minutes=m)
    rows = [("a", "warning", at(8), 1), ("a", "warning", at(20), 2), ("a", "warning", at(21), 3), ("b", "warning", at(20), 4),
            ("a", "critical", at(20), 5), ("a", "info", at(20), 6), ("a", None, at(20), 7), ("a", "warning", at(19, 59), 8)]
    df = spark.createDataFrame(rows, "service string, severity string, time timestamp, n int")
    firing = spark.createDataFrame(
        [("a", "critical", at(20), at(21)), ("a", "warning", at(0), at(24)), ("c", "critical", at(0), at(24))],
        "service string, severity string, starts_at timestamp, ends_at timestamp",
    )
    assert sorted(r["n"] for r in alerts.inhibit(df, firing).collect()) == [1, 3, 4, 5, 6, 7, 8]


def test_alert_states(spark):
    """pending, firing, resolved; two true evaluations hours apart are no hold."""
    minutes = [(0, True), (1, True), (2, True), (3, False), (4, True), (5, False), (6, True), (540, True), (541, True), (542, True), (543, None)]
    rows = [("r", T0 + timedelta(minutes=m), h) for m, h in minutes]
    held = alerts.hold(spark.createDataFrame(rows, "rule string, tick timestamp, holds boolean"), ["rule"], 120, 60)
    got = [(r["state"], r["firing"]) for r in held.orderBy("tick").collect()]
    states = ["pending", "pending", "firing", "resolved", "pending", "inactive", "pending", "pending", "pending", "firing", "resolved"]
    assert got == [(s, s == "firing") for s in states]
    spans = sorted((r["starts_at"], r["ends_at"]) for r in alerts.firing_spans(held, ["rule"], 60).collect())
    assert spans == [(T0 + timedelta(minutes=m), T0 + timedelta(minutes=m + 1)) for m in (2, 542)]


def test_alert_pipeline(spark):
    """A critical alert fires in hours 3 to 5; warnings of its service are mute then and repeat after 4 hours."""
    hours = range(14)
    rows = [("Down", "a", T0 + timedelta(hours=h), h in (2, 3, 4, 5)) for h in hours]
    rows += [("Slow", s, T0 + timedelta(hours=h), True) for h in hours for s in ("a", "b")]
    df = spark.createDataFrame(rows, "alertname string, service string, tick timestamp, holds boolean")
    rules = [("Down", "critical", 3600), ("Slow", "warning", 0)]
    got = sorted((r["alertname"], r["service"], (r["time"] - T0).total_seconds() / 3600) for r in alerts.alert_pipeline(df, rules, 3600).collect())
    assert got == [("Down", "a", h) for h in (3, 4, 5)] + [("Slow", "a", h) for h in (0, 6, 10)] + [("Slow", "b", h) for h in (0, 4, 8, 12)]


def test_cost_is_evaluated_in_hours_without_reports(spark):
    rows = [(T0, 4.0), (T0 + timedelta(hours=2, minutes=5), 2.0)]
    df = spark.createDataFrame(rows, "generated_at timestamp, cost_usd double")
    got = {(r["tick"] - T0).total_seconds() / 3600: (r["cost_1d"], r["holds"]) for r in alerts.cost_alert(df, T0 + timedelta(hours=30)).collect()}
    assert len(got) == 31 and got[1] == (4.0, False) and got[2] == (6.0, True) and got[23] == (6.0, True) and got[24] == (2.0, False)
    assert got[26] == (0.0, False) and got[30] == (0.0, False)


def test_a_score_shift_needs_scores(spark):
    df = spark.createDataFrame([(T0, -0.5), (T0 + timedelta(hours=5), -2.0)], "time timestamp, score double")
    got = [(r["short_median"], r["long_median"], r["holds"]) for r in alerts.score_shift(df).orderBy("tick").collect()]
    assert got == [(-0.5, -0.5, False)] + [(None, -0.5, False)] * 4 + [(-2.0, -1.25, True)]


def test_notices_of_all_routes_in_one_plan(spark):
    at = lambda h: T0 + timedelta(hours=h)
    rows = [("x", "s", sev, at(h), f"{sev}{h:02d}") for sev in ("critical", "warning", "info") for h in range(0, 25)]
    df = spark.createDataFrame(rows, "alertname string, service string, severity string, time timestamp, anomaly_id string")
    out = alerts.alert_notices(df)
    got = sorted((r["route"], (r["time"] - T0).total_seconds() // 3600) for r in out.collect())
    assert got == sorted([("critical", h) for h in range(25)] + [("warning", h) for h in range(0, 25, 4)] + [("default", h) for h in (0, 12, 24)])
    assert "Python" not in out._jdf.queryExecution().toString()


def test_histogram_quantile(spark):
    df = spark.createDataFrame([(v,) for v in [1.0] * 50 + [7.0] * 40 + [500.0] * 10], "v double")
    got = {r["q"]: r["value"] for r in rollups.histogram_quantiles(df, "v", (5.0, 10.0, 100.0), (0.25, 0.5, 0.7, 0.99)).collect()}
    assert np.allclose([got[0.25], got[0.5], got[0.7], got[0.99]], [2.5, 5.0, 7.5, 100.0])


def test_search_filters_and_anomaly_defaults(spark):
    rows = [(i, T0 + timedelta(minutes=i), "svc", "INFO", f"User Logged {i}", "t1") for i in range(5)]
    df = spark.createDataFrame(rows, "event_id int, time timestamp, service string, level string, message string, trace_id string")
    got = listing.search_events(df, T0 + timedelta(hours=1), search="logged", trace_id="t1", limit=2, tiebreak="event_id")
    assert [r["event_id"] for r in got.collect()] == [4, 3]


def test_alert_and_stored_anomaly(spark):
    rows = [("payment-service", T0, -0.9, -0.7, 80, T0, T0, 0.4, 5000.0, [-0.1, 0.6])]
    flagged = spark.createDataFrame(rows, "service string, detected_at timestamp, score double, threshold double, window_size long, window_start timestamp, window_end timestamp, error_rate double, p95_latency_ms double, shap array<double>")
    record = alerts.alert_records(flagged, ("error_rate", "p95_latency_ms"))
    a = record.first()
    assert a["id"] == "anomaly_payment-service_1704067200" and a["severity"] == "high"
    assert [(t["name"], t["direction"]) for t in a["top_features"]] == [("p95_latency_ms", "toward_normal"), ("error_rate", "toward_anomaly")]
    stored = alerts.anomaly_rows(record).first()
    assert stored["severity"] == "HIGH" and stored["features"]["values"]["p95_latency_ms"] == 5000.0


def test_features_without_reference_values_are_reported(spark):
    nan = float("nan")
    ref = spark.createDataFrame([("x", float(i)) for i in range(50)] + [("y", None), ("y", nan)], "feature string, value double")
    cur = spark.createDataFrame([("x", float(i)) for i in range(50)] + [("y", 5.0)], "feature string, value double")
    edges = {r["feature"]: r["edges"] for r in drift.quantile_edges(ref).collect()}
    got = {r["feature"]: r["severity"] for r in drift.psi(ref, cur).collect()}
    assert edges["y"] == [0.0, 1.0] and got == {"x": "ok", "y": "major"}
