"""Detection per service: at every check, the newest events of a service are one window that is scored.

A check happens at the first event at least the interval after the last one (``windows.event_checks``). Windows with
fewer than ``min_events`` events are not scored. A flagged window raises an alert unless one of its service was kept
less than the cooldown before. ``detections`` does this over stored events; ``ForestJudge`` and ``RuleJudge`` are the
same for one window in a streaming task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.operators import alerts, forest
from vigilspark.operators.features import window_features
from vigilspark.operators.windows import event_checks, trailing_buffer
from vigilspark.plans.cooldown import cooldown_kept
from vigilspark.schema import ERROR_LEVELS, FEATURE_NAMES, KNOWN_SERVICES
from vigilspark.session import materialize

#: What a scored check is, with times in micros; ``features`` are in the order of FEATURE_NAMES.
DETECTION = (
    "service string, tick_us long, window_size long, start_us long, end_us long, score double, threshold double, "
    "is_anomaly boolean, features array<double>, kept boolean"
)
#: The rule score of a window: this minus its error rate, lower is worse.
RULE_BASE = 0.05


def window_vector(window: pd.DataFrame) -> np.ndarray:
    """The 27 features of one window (service, level, valid_latency), as ``window_features`` has them."""
    bad = window["level"].isin(ERROR_LEVELS).to_numpy()
    latency = window["valid_latency"].to_numpy(dtype=float, na_value=np.nan)
    service = window["service"].to_numpy()

    def tail(values: np.ndarray, p: float) -> float:
        return float(np.percentile(values, p)) if len(values) else 0.0

    known = latency[~np.isnan(latency)]
    n, rate = float(len(window)), float(bad.mean()) if len(window) else 0.0
    p50, p95, p99 = (tail(known, p) for p in (50, 95, 99))
    std = float(known.std()) if len(known) else 0.0
    out = [n, rate, p50, p95, p99, std, p95 / (p50 + 1), p99 / (p95 + 1), n * rate, np.log1p(n), np.log1p(rate * 1000)]
    for name in KNOWN_SERVICES:
        mine = service == name
        out += [float(bad[mine].mean()) if mine.any() else 0.0, tail(latency[mine & ~np.isnan(latency)], 95)]
    return np.array(out)


class RuleJudge:
    """Flags a window whose rule score is below the threshold."""

    def __init__(self, threshold: float, min_events: int = 10):
        self.threshold, self.min_events = threshold, min_events

    def score(self, vector: np.ndarray) -> float:
        return round(RULE_BASE - float(vector[1]), 6)

    def __call__(self, service: str, check: int, window: pd.DataFrame) -> pd.DataFrame | None:
        if len(window) < self.min_events:
            return None
        vector = window_vector(window.assign(service=service))
        score = self.score(vector)
        times = window["at_us"]
        row = (service, check, len(window), int(times.min()), int(times.max()), score, self.threshold, score < self.threshold, vector.tolist())
        names = ("service", "tick_us", "window_size", "start_us", "end_us", "score", "threshold", "is_anomaly", "features")
        return pd.DataFrame([row], columns=names)


class ForestJudge(RuleJudge):
    """Scores windows with a fitted forest; its node table (trees x 511 rows at most) travels with the object."""

    def __init__(self, model: forest.Forest, threshold: float | None = None, min_events: int = 10):
        meta = model.meta.first().asDict()
        super().__init__(float(meta["threshold"] if threshold is None else threshold), min_events)
        scaler = model.scaler.first()["scaler"]
        self.mean = np.array([scaler[n]["mean"] for n in model.names])
        self.scale = np.array([scaler[n]["scale"] for n in model.names])
        self.at = [FEATURE_NAMES.index(n) for n in model.names]
        self.trees = forest.packed(forest.node_table(model.nodes))
        self.norm, self.offset = float(forest.average_path(meta["psi"])) or 1.0, float(meta["offset"])

    def score(self, vector: np.ndarray) -> float:
        x = ((vector[self.at] - self.mean) / self.scale)[None, :]
        return float(-np.power(2.0, -forest.mean_path(self.trees, x) / self.norm)[0]) - self.offset


def check_windows(events: DataFrame, interval_s: int, size: int = 1000, min_events: int = 10, tiebreak: str = "event_id") -> DataFrame:
    """Feature rows of every check with enough events: service, tick, window_size, window_start, window_end, features."""
    slim = materialize(events.select("service", "time", tiebreak, "level", "valid_latency"))
    buffered = materialize(trailing_buffer(slim, event_checks(slim, interval_s), size, "tick", tiebreak))
    keys = ["checked", "tick"]
    spans = buffered.groupBy(F.col("service").alias("checked"), "tick").agg(
        F.count("*").alias("window_size"), F.min("time").alias("window_start"), F.max("time").alias("window_end")
    )
    features = window_features(buffered.withColumn("checked", F.col("service")), keys, min_events)
    return features.join(spans, keys).withColumnRenamed("checked", "service")


def detections(
    events: DataFrame,
    interval_s: int,
    size: int = 1000,
    min_events: int = 10,
    cooldown_s: int = 120,
    model: forest.Forest | None = None,
    threshold: float | None = None,
    tiebreak: str = "event_id",
) -> DataFrame:
    """Every scored check of stored events with ``score``, ``threshold``, ``is_anomaly`` and ``kept``.

    Without a model the rule score counts; ``threshold`` is then needed.
    """
    rows = check_windows(events, interval_s, size, min_events, tiebreak)
    if model is None:
        scored = rows.withColumns({"score": F.round(F.lit(RULE_BASE) - F.col("error_rate"), 6), "threshold": F.lit(float(threshold))})
        scored = scored.withColumn("is_anomaly", F.col("score") < F.col("threshold"))
    else:
        scored = forest.score(rows, model, threshold)
    scored = materialize(scored.withColumn("anomaly_id", alerts.anomaly_id(F.col("service"), F.col("tick"))))
    flagged = scored.where("is_anomaly").select("service", "tick", "anomaly_id")
    kept = cooldown_kept(flagged, ["service"], "tick", "anomaly_id", cooldown_s).select("service", "tick", F.lit(True).alias("kept"))
    return scored.join(kept, ["service", "tick"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def typed(rows: DataFrame) -> DataFrame:
    """Rows of the form DETECTION in the form of ``detections``: times as timestamps, a column per feature."""
    micros = {"tick": "tick_us", "window_start": "start_us", "window_end": "end_us"}
    return rows.select(
        "service", *[F.timestamp_micros(c).alias(n) for n, c in micros.items()], "window_size", "score", "threshold", "is_anomaly", "kept",
        alerts.anomaly_id(F.col("service"), F.timestamp_micros("tick_us")).alias("anomaly_id"),
        *[F.get("features", F.lit(i)).alias(n) for i, n in enumerate(FEATURE_NAMES)],
    )
