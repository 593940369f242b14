"""Severity, rule detector, alert records, suppression, and alert rules over tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilspark.functions.scalars import direction, safe_ratio
from vigilspark.plans.cooldown import cooldown_kept
from vigilspark.plans.intervals import points_in_spans
from vigilspark.plans.ordering import exact_percentiles
from vigilspark.schema import FEATURE_NAMES
from vigilspark.session import materialize

# Fixed values of the alert routes: seconds between repeats of one notice.
REPEAT_SECONDS = (("critical", 3_600), ("warning", 14_400), ("default", 43_200))


def severity(score: Column, error_rate: Column) -> Column:
    """Severity class of a flagged window (lower case, as alerts carry it)."""
    return (
        F.when((score < -1.0) | (error_rate > 0.5), "critical")
        .when((score < -0.85) | (error_rate > 0.3), "high")
        .when((score < -0.7) | (error_rate > 0.15), "medium")
        .otherwise("low")
    )


def rule_baseline(train: DataFrame) -> DataFrame:
    """One row: the median p95 latency of (clean) training windows."""
    return exact_percentiles(train, [], "p95_latency_ms", {"baseline_p95": 0.5})


def rule_detector(
    features: DataFrame, baseline: DataFrame, error_threshold: float = 0.05, latency_multiple: float = 2.0
) -> DataFrame:
    """Add ``predicted``: error rate above its bound, or p95 above a multiple of the baseline."""
    limit = baseline.select(F.col("baseline_p95") * latency_multiple).scalar()
    return features.withColumn(
        "predicted", ((F.col("error_rate") > error_threshold) | (F.col("p95_latency_ms") > limit)).cast("int")
    )


def anomaly_id(service: Column, moment: Column) -> Column:
    return F.concat_ws("_", F.lit("anomaly"), service, F.unix_timestamp(moment).cast("string"))


def top_features(
    names: Column, values: Column, shap: Column, k: int = 3
) -> Column:
    """The ``k`` attributions largest in absolute value (first name order breaks ties), with raw values."""
    items = F.transform(
        F.arrays_zip(names.alias("name"), values.alias("value"), shap.alias("shap")),
        lambda x, i: F.struct(
            (-F.abs(x["shap"])).alias("key"),
            i.alias("at"),
            x["name"].alias("name"),
            x["value"].alias("value"),
            x["shap"].alias("shap"),
        ),
    )
    ranked = F.slice(F.array_sort(items), 1, k)
    return F.transform(
        ranked,
        lambda x: F.struct(
            x["name"].alias("name"), x["value"].alias("value"), x["shap"].alias("shap"), direction(x["shap"]).alias("direction")
        ),
    )


def alert_records(flagged: DataFrame, names: Sequence[str] = FEATURE_NAMES) -> DataFrame:
    """Alert rows from flagged windows: ``service, detected_at, score, threshold, window_size,
    window_start, window_end``, the feature columns, and optionally ``shap`` (array in feature order)."""
    keys = F.array(*[F.lit(n) for n in names])
    values = F.array(*[F.col(f"`{n}`") for n in names])
    top = (
        top_features(keys, values, F.col("shap"))
        if "shap" in flagged.columns
        else F.from_json(F.lit("[]"), "array<struct<name:string,value:double,shap:double,direction:string>>")
    )
    return flagged.select(
        anomaly_id(F.col("service"), F.col("detected_at")).alias("id"),
        F.col("detected_at").alias("timestamp"),
        "service",
        severity(F.col("score"), F.col("error_rate")).alias("severity"),
        "score",
        "threshold",
        F.map_from_arrays(keys, values).alias("features"),
        top.alias("top_features"),
        "window_size",
        "window_start",
        "window_end",
    )


def anomaly_rows(alerts: DataFrame) -> DataFrame:
    """Alerts in the stored form: severity in upper case, the payload packed into ``features``."""
    return alerts.select(
        F.col("timestamp").alias("time"),
        F.col("id").alias("anomaly_id"),
        "service",
        "score",
        "threshold",
        F.upper("severity").alias("severity"),
        F.struct(F.col("features").alias("values"), "top_features", "window_size", "window_start", "window_end").alias("features"),
        F.lit(None).cast("double").alias("confidence"),
        F.lit(False).alias("is_resolved"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
        F.col("timestamp").alias("created_at"),
    )


def suppress_repeats(alerts: DataFrame, cooldown_seconds: int = 120, time: str = "time", tiebreak: str = "anomaly_id") -> DataFrame:
    """Alerts at least the cooldown after the last kept alert of their service."""
    return cooldown_kept(alerts, ["service"], time, tiebreak, cooldown_seconds)


def alert_notices(alerts: DataFrame, tiebreak: str = "anomaly_id") -> DataFrame:
    """Notices after grouping by (alertname, service): repeats only after the interval of the severity.

    Adds ``route``; all routes go through one plan, the interval is a column.
    """
    names = [route for route, _ in REPEAT_SECONDS]
    severity = F.col("severity")
    route = F.when(severity.isin(*names[:-1]), severity).otherwise(F.lit(names[-1]))
    wait = F.element_at(F.create_map(*[F.lit(x) for pair in REPEAT_SECONDS for x in pair]), F.col("route"))
    return cooldown_kept(alerts.withColumn("route", route), ["alertname", "service", "route"], "time", tiebreak, wait)


def inhibit(
    alerts: DataFrame,
    firing: DataFrame,
    keys: Sequence[str] = ("service",),
    time: str = "time",
    span: tuple[str, str] = ("starts_at", "ends_at"),
    cell_seconds: int = 3_600,
) -> DataFrame:
    """Drop warnings raised while a critical alert of the same keys fires.

    ``firing`` holds spans with ``severity`` (``firing_spans``), the end not included; only critical ones count.
    """
    start, end = span
    critical = firing.where(F.col("severity") == "critical").select(*keys, start, end)
    warning = F.coalesce(F.col("severity") == "warning", F.lit(False))
    kept = points_in_spans(
        alerts.where(warning), critical, time, span, cell_seconds, keys, "left_anti", F.col(f"p.{time}") < F.col(f"s.{end}")
    )
    return alerts.where(~warning).unionByName(kept)


def hold(
    evaluations: DataFrame, keys: Sequence[str], hold_seconds: Column | int, interval_seconds: int, tick: str = "tick"
) -> DataFrame:
    """Alert states of rule evaluations: adds ``pending_since``, ``firing`` and ``state``.

    The condition (``holds``) must be true at every evaluation of the hold time. An evaluation that is missing, so
    that two of them lie more than ``interval_seconds`` apart, breaks it like a false one. ``state`` is inactive,
    pending, firing, or resolved at the first evaluation after a firing one that doesn't fire.

    Rows are rule evaluations, one per key and tick, so a key's rows are bounded by the clock.
    """
    order = Window.partitionBy(*keys).orderBy(tick)
    wait = F.lit(hold_seconds) if isinstance(hold_seconds, int) else hold_seconds
    true = F.coalesce("holds", F.lit(False))
    gap = F.unix_micros(tick) - F.unix_micros(F.lag(tick).over(order)) > interval_seconds * 1_000_000
    breaks = F.sum((~F.col("_true") | F.col("_gap")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    since = F.min(F.when(F.col("_true"), F.col(tick))).over(Window.partitionBy(*keys, "_island"))
    fired = F.col("_true") & (F.unix_timestamp(tick) - F.unix_timestamp("pending_since") >= wait)
    before = F.coalesce(F.lag("firing").over(order), F.lit(False))
    state = F.when(F.col("firing"), "firing").when(before, "resolved").when(F.col("_true"), "pending").otherwise("inactive")
    return (
        evaluations.withColumns({"_true": true, "_gap": F.coalesce(gap, F.lit(False))})
        .withColumn("_island", breaks)
        .withColumn("pending_since", F.when(F.col("_true"), since))
        .withColumn("firing", F.coalesce(fired, F.lit(False)))
        .withColumn("state", state)
        .drop("_island", "_true", "_gap")
    )


def firing_spans(held: DataFrame, keys: Sequence[str], interval_seconds: int, tick: str = "tick") -> DataFrame:
    """From the first firing evaluation to the interval after the last one: keys, starts_at, ends_at (not included)."""
    step = F.expr(f"INTERVAL {int(interval_seconds)} SECONDS")
    spans = held.where("firing").groupBy(*keys, "pending_since").agg(F.min(tick).alias("starts_at"), F.max(tick).alias("_last"))
    return spans.select(*keys, "starts_at", (F.col("_last") + step).alias("ends_at"))


def spine(spark: SparkSession, first: datetime, last: datetime, step_seconds: int) -> DataFrame:
    """Evaluation times from ``first`` to ``last``, both included: ``tick``."""
    n = int((last - first).total_seconds()) // step_seconds + 1
    start = F.unix_micros(F.lit(first))
    return spark.range(max(0, n)).select(F.timestamp_micros(start + F.col("id") * (step_seconds * 1_000_000)).alias("tick"))


def alert_pipeline(evaluations: DataFrame, rules: Sequence[tuple[str, str, int]], interval_seconds: int) -> DataFrame:
    """Notices of rule evaluations: hold times, states, inhibition and repeat intervals in turn.

    ``evaluations``: alertname, service, tick, holds; ``rules``: (alertname, severity, hold seconds). A firing alert
    asks for a notice at every evaluation; warnings are mute while a critical alert of their service fires, and what
    is left is sent again only after the repeat interval of its severity.
    """
    spark = evaluations.sparkSession
    known = spark.createDataFrame(list(rules), "alertname string, severity string, hold_s long")
    keys = ["alertname", "service", "severity"]
    held = materialize(hold(evaluations.join(known, "alertname"), keys, F.col("hold_s"), interval_seconds))
    asked = held.where("firing").select(*keys, F.col("tick").alias("time"), "pending_since")
    heard = inhibit(asked, firing_spans(held, keys, interval_seconds))
    named = heard.withColumn("anomaly_id", F.concat_ws("/", "alertname", "service", F.unix_timestamp("time").cast("string")))
    return alert_notices(named)


def rate_alert(counts: DataFrame, keys: Sequence[str], seconds: int, limit: float, bucket: str = "bucket") -> DataFrame:
    """Per-second rate over a trailing range of per-minute counts against a limit."""
    order = Window.partitionBy(*keys).orderBy(F.unix_timestamp(bucket)).rangeBetween(-(seconds - 1), 0)
    return counts.withColumn("rate", F.sum("n").over(order) / F.lit(float(seconds))).withColumn("holds", F.col("rate") > limit)


def cost_alert(reports: DataFrame, until: datetime, limit: float = 5.0) -> DataFrame:
    """Cost over the trailing day at every full hour from the first report's to ``until``, against the limit.

    Costs are summed per hour first; the trailing day adds at most 24 rows. Hours without reports are evaluated too.
    """
    hour = F.expr("INTERVAL 1 HOUR")
    hourly = reports.groupBy(F.date_trunc("hour", "generated_at").alias("tick")).agg(F.sum("cost_usd").alias("cost"))
    spread = hourly.select(F.explode(F.sequence("tick", F.col("tick") + F.expr("INTERVAL 23 HOURS"), hour)).alias("tick"), "cost")
    first = reports.agg(F.date_trunc("hour", F.min("generated_at")).alias("first"))
    ticks = first.where(F.col("first") <= F.lit(until)).select(F.explode(F.sequence("first", F.lit(until).cast("timestamp"), hour)).alias("tick"))
    return (
        ticks.join(spread, "tick", "left")
        .groupBy("tick")
        .agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost_1d"))
        .withColumn("holds", F.col("cost_1d") > limit)
    )


def model_age(models: DataFrame, as_of: datetime) -> DataFrame:
    """Age in days of each model, never negative, with the stale flag (over 30 days)."""
    days = (F.unix_micros(F.lit(as_of)) - F.unix_micros("training_date")) / F.lit(86_400e6)
    return models.withColumn("age_days", F.greatest(F.lit(0.0), days)).withColumn("stale", F.col("age_days") > 30)


def drift_alerts(drift: DataFrame, limit: float = 0.25) -> DataFrame:
    """Features whose highest PSI is over the limit."""
    return drift.groupBy("feature").agg(F.max("psi").alias("value")).where(F.col("value") > limit)


def explained_ratio(anomalies: DataFrame, width: str = "1 hour") -> DataFrame:
    """Share of flagged windows that carry attributions, per time bucket."""
    return anomalies.groupBy(F.window("time", width)["start"].alias("bucket")).agg(
        F.count("*").alias("flagged"),
        F.count_if(F.size("features.top_features") > 0).alias("explained"),
        (
            F.count_if(F.size("features.top_features") > 0) / F.greatest(F.count("*").cast("double"), F.lit(1e-9))
        ).alias("ratio"),
    )


def latency_alert(
    rows: DataFrame, value: str, quantile: float, limit: float, window_s: int = 300, tick_s: int = 60, keys: Sequence[str] = ()
) -> DataFrame:
    """Exact quantile of ``value`` over the trailing window at each tick, against the limit.

    A row reaches the ticks of the following window only (``window_s / tick_s`` of them).
    """
    ticks = F.window("time", f"{window_s} seconds", f"{tick_s} seconds")
    moved = rows.select(*keys, ticks["end"].alias("tick"), F.col(value).alias("value"))
    return exact_percentiles(moved, [*keys, "tick"], "value", {"value": quantile}).withColumn("holds", F.col("value") > limit)


def score_shift(scored: DataFrame, time: str = "time", short_h: int = 1, long_h: int = 24, limit: float = 0.5) -> DataFrame:
    """Median score of the last ``short_h`` hours against the last ``long_h`` hours at every hour from the first to
    the last with scores. A median without scores is null, and then the rule doesn't hold.

    Equal scores of an hour are counted once before they are spread over the ticks they affect.
    """
    hour = F.expr("INTERVAL 1 HOUR")
    counted = materialize(scored.groupBy(F.date_trunc("hour", time).alias("_h"), "score").agg(F.count("*").alias("n")))
    ticks = counted.agg(F.min("_h").alias("a"), F.max("_h").alias("b")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "b", hour)).alias("_h"))

    def median(hours: int, name: str) -> DataFrame:
        spread = counted.select(
            F.explode(F.sequence("_h", F.col("_h") + F.expr(f"INTERVAL {hours - 1} HOURS"), hour)).alias("_h"), "score", "n"
        )
        return exact_percentiles(spread, ["_h"], "score", {name: 0.5}, "n")

    change = F.abs(F.col("short_median") - F.col("long_median")) / F.abs(F.col("long_median") + 1e-9)
    return (
        ticks.join(median(short_h, "short_median"), "_h", "left")
        .join(median(long_h, "long_median"), "_h", "left")
        .withColumnRenamed("_h", "tick")
        .withColumn("change", change)
        .withColumn("holds", F.coalesce(F.col("change") > limit, F.lit(False)))
    )
