"""Plan helpers against brute force, including hot keys and odd values."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigilspark.operators.windows import event_checks, trailing_buffer
from vigilspark.plans.cooldown import cooldown_kept
from vigilspark.plans.chains import chained
from vigilspark.plans.intervals import overlap_candidates, overlap_pairs, points_in_spans
from vigilspark.plans.ordering import exact_percentiles, global_rank, running_sums, value_cell

T0 = datetime(2024, 1, 1)


def test_value_cell_is_monotone(spark):
    values = sorted([0.0, -0.0, 1e-310, 1e-300, -1e-9, -5.0, -4.99, 3.0, 3.0000001, 1e9, 1e300, float("inf"), -float("inf"), *np.random.default_rng(1).normal(0, 100, 500)])
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", value_cell(F.col("v")).alias("c")).toPandas()
    cells = rows.sort_values("v")["c"].to_numpy()
    assert (np.diff(cells) >= 0).all()


def test_exact_percentiles_hot_key_ties_and_nan(spark):
    rng = np.random.default_rng(7)
    rows = [("hot", float(v)) for v in rng.lognormal(3, 1, 3000)] + [("tie", 5.0)] * 50 + [("neg", float(v)) for v in rng.normal(-2, 3, 101)]
    rows += [("one", 42.0), ("hot", float("nan")), ("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r["k"]: r for r in exact_percentiles(df, ["k"], "v", {"a": 0.5, "b": 0.95, "c": 0.0, "d": 1.0}).collect()}
    assert set(got) == {"hot", "tie", "neg", "one"}
    for key in got:
        values = [v for k, v in rows if k == key and v is not None and v == v]
        want = np.percentile(values, [50, 95, 0, 100])
        assert np.allclose([got[key][c] for c in "abcd"], want, rtol=1e-12)


def test_exact_percentiles_weighted_and_global(spark):
    rows = [(1.0, 3), (2.0, 1), (10.0, 6)]
    df = spark.createDataFrame(rows, "v double, n long")
    flat = [v for v, n in rows for _ in range(n)]
    got = exact_percentiles(df, [], "v", {"m": 0.3, "h": 0.99}, "n").first()
    assert np.allclose([got["m"], got["h"]], np.percentile(flat, [30, 99]))


def test_percentile_plan_shares_its_count_exchange(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    out = exact_percentiles(df, ["k"], "v", {"m": 0.5})
    out.collect()
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()


def test_running_sums_and_rank(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randint(0, 40), i, rng.randint(1, 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v int, id int, w int")
    out = running_sums(df, F.floor(F.col("v") / 7), [F.col("v"), F.col("id")], {"run": F.col("w")}, ["k"])
    got = {r["id"]: r["run"] for r in out.collect()}
    pdf = pd.DataFrame(rows, columns=["k", "v", "id", "w"]).sort_values(["k", "v", "id"])
    pdf["run"] = pdf.groupby("k")["w"].cumsum()
    assert got == dict(zip(pdf["id"], pdf["run"]))
    ranks = global_rank(df, F.floor(F.col("v") / 7), [F.col("v"), F.col("id")]).collect()
    order = [r["id"] for r in sorted(ranks, key=lambda r: r["rank"])]
    assert order == list(pd.DataFrame(rows, columns=["k", "v", "id", "w"]).sort_values(["v", "id"])["id"])


def test_overlap_pairs_and_points(spark):
    rng = random.Random(5)

    def spans(n, longest):
        out = []
        for i in range(n):
            start = T0 + timedelta(minutes=rng.randint(0, 5000))
            out.append((i, start, start + timedelta(minutes=rng.randint(1, longest))))
        return out

    a, b = spans(60, 300), spans(40, 2000)
    for m in (0, 7, 4000):  # empty spans and equal ones
        a += [(100 + m, T0 + timedelta(minutes=m), T0 + timedelta(minutes=m)), (200 + m, *b[m % 40][1:])]
        b += [(300 + m, T0 + timedelta(minutes=m), T0 + timedelta(minutes=m)), (400 + m, T0 + timedelta(days=-m), T0 + timedelta(days=m))]
    left = spark.createDataFrame(a, "a int, s1 timestamp, e1 timestamp")
    right = spark.createDataFrame(b, "b int, s2 timestamp, e2 timestamp")
    for unit in (60, 600, 86_400):
        got = [(r["a"], r["b"]) for r in overlap_pairs(left, right, ("s1", "e1"), ("s2", "e2"), unit).collect()]
        want = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and x[2] > y[1]]
        assert sorted(got) == sorted(want)
    points = spark.createDataFrame([(i, T0 + timedelta(minutes=i * 7)) for i in range(700)], "p int, at timestamp")
    got = {(r["p"], r["b"]) for r in points_in_spans(points, right, "at", ("s2", "e2"), 3_600).collect()}
    want = {(i, y[0]) for i in range(700) for y in b if y[1] <= T0 + timedelta(minutes=i * 7) <= y[2]}
    missed = {i for i in range(700)} - {i for i, _ in want}
    assert got == want | {(i, None) for i in missed}


def test_overlap_candidates_follow_the_result(spark):
    """Minute windows every 30 s against spans of minutes to hours: few pairs are looked at in vain."""
    rng = random.Random(6)
    windows = [(i, T0 + timedelta(seconds=30 * i), T0 + timedelta(seconds=30 * i + 60)) for i in range(2_880)]
    begins = [T0 + timedelta(seconds=rng.randrange(86_400)) for _ in range(40)]
    spans = [(i, s, s + timedelta(seconds=rng.choice([45, 90, 600, 7_200]))) for i, s in enumerate(begins)]
    left = spark.createDataFrame(windows, "a int, s1 timestamp, e1 timestamp")
    right = spark.createDataFrame(spans, "b int, s2 timestamp, e2 timestamp")
    found = sum(s1 < e2 and e1 > s2 for _, s1, e1 in windows for _, s2, e2 in spans)
    assert overlap_pairs(left, right, ("s1", "e1"), ("s2", "e2"), 60).count() == found
    assert overlap_candidates(left, right, ("s1", "e1"), ("s2", "e2"), 60).count() <= 4 * found


def test_chains_with_waits_of_their_own(spark):
    """Several keys, each with its wait, dense and with gaps, against a walk."""
    rng = random.Random(12)
    rows, want = [], set()
    for key, wait in (("dense", 1_000), ("sparse", 50_000), ("one", 9_000), ("long", 10**9)):
        times = sorted({rng.randrange(10**6) * (1 if rng.random() < 0.7 else 50) for _ in range(400 if key != "one" else 1)})
        rows += [(key, t, wait) for t in times] * 2
        last = None
        for t in times:
            if last is None or t - last >= wait:
                want.add((key, t))
                last = t
    df = spark.createDataFrame([*rows, (None, 5, 9), ("one", None, 7)], "k string, t long, w long").repartition(7)
    got = [tuple(r) for r in chained(df, ["k"], "t", F.col("w")).collect()]
    assert len(got) == len(want) and set(got) == want
    assert chained(df.limit(0), ["k"], "t", 5).count() == 0


def test_checks_need_events(spark):
    """Checks follow events: none in silence, and the next one counts from the last check."""
    seconds = [0, 10, 59, 60, 61, 119, 125, 1000, 1001, 1059, 1060, 1300]
    rows = [("s", T0 + timedelta(seconds=s), i) for i, s in enumerate(seconds)]
    df = spark.createDataFrame(rows, "service string, time timestamp, event_id long")
    got = [(r["tick"] - T0).total_seconds() for r in event_checks(df, 60).orderBy("tick").collect()]
    assert got == [60, 125, 1000, 1060, 1300]


def _cooldown(times, wait):
    kept, last = [], None
    for t in sorted(times):
        if last is None or t - last >= wait:
            kept.append(t)
            last = t
    return kept


@pytest.mark.parametrize("density", [3, 40, 900])
def test_cooldown_matches_the_sequential_rule(spark, density):
    rng = random.Random(density)
    wait = 120
    rows = []
    for key in ("hot", "cold"):
        n = 1200 if key == "hot" else 60
        rows += [(key, T0 + timedelta(seconds=rng.randint(0, density * n // 10 + 1)), f"{key}{i:05d}") for i in range(n)]
    df = spark.createDataFrame(rows, "service string, time timestamp, anomaly_id string").repartition(5)
    got = cooldown_kept(df, ["service"], "time", "anomaly_id", wait).collect()
    for key in ("hot", "cold"):
        want = _cooldown({t for k, t, _ in rows if k == key}, timedelta(seconds=wait))
        assert sorted(r["time"] for r in got if r["service"] == key) == want


def test_cooldown_keeps_the_entry_state(spark):
    df = spark.createDataFrame(
        [("s", T0 + timedelta(seconds=x), f"a{x:04d}") for x in (0, 50, 119, 120, 200, 241)], "service string, time timestamp, anomaly_id string"
    )
    blocked = int((T0 - datetime(1970, 1, 1)).total_seconds() + 60) * 1_000_000
    entry = spark.createDataFrame([("s", blocked)], "service string, blocked_until long")
    got = sorted(r["anomaly_id"] for r in cooldown_kept(df, ["service"], "time", "anomaly_id", 120, entry).collect())
    assert got == ["a0119", "a0241"]


def test_trailing_buffer_matches_a_deque(spark):
    rng = random.Random(11)
    events = [(i, rng.choice(["hot"] * 8 + ["cold"]), T0 + timedelta(seconds=rng.randint(0, 7200))) for i in range(900)]
    ticks = [(s, T0 + timedelta(seconds=600 * k)) for s in ("hot", "cold") for k in range(13)]
    e = spark.createDataFrame(events, "event_id long, service string, time timestamp")
    t = spark.createDataFrame(ticks, "service string, tick timestamp")
    for size in (1, 25, 1000):
        got = {}
        for r in trailing_buffer(e, t, size).collect():
            got.setdefault((r["service"], r["tick"]), set()).add(r["event_id"])
        for s, at in ticks:
            past = sorted((x[2], x[0]) for x in events if x[1] == s and x[2] <= at)[-size:]
            assert got.get((s, at), set()) == {i for _, i in past}
