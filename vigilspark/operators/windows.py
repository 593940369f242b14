"""Event windows: sliding windows, spine, labels, splits and count-bounded trailing buffers."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.plans.chains import chained
from vigilspark.plans.intervals import overlap_pairs, points_in_spans
from vigilspark.plans.ordering import global_rank, running_sums, time_cell, time_cells


def _epoch(moment: datetime) -> int:
    return int((moment - datetime(1970, 1, 1)).total_seconds())


def assign_windows(events: DataFrame, start: datetime, end: datetime, size_s: int, stride_s: int) -> DataFrame:
    """Each event once per sliding window that holds it; windows start at ``start`` and end by ``end``."""
    window = F.window("time", f"{size_s} seconds", f"{stride_s} seconds", f"{_epoch(start) % stride_s} seconds")
    return (
        events.where((F.col("time") >= F.lit(start)) & (F.col("time") < F.lit(end)))
        .withColumn("_w", window)
        .where((F.col("_w.start") >= F.lit(start)) & (F.col("_w.end") <= F.lit(end)))
        .withColumn("window_start", F.col("_w.start"))
        .withColumn("window_end", F.col("_w.end"))
        .drop("_w")
    )


def window_spine(spark: SparkSession, start: datetime, end: datetime, size_s: int, stride_s: int) -> DataFrame:
    """All full windows of a timeline, empty ones included."""
    n = max(0, (_epoch(end) - _epoch(start) - size_s) // stride_s + 1)
    begin = F.timestamp_seconds(F.lit(_epoch(start)) + F.col("id") * stride_s)
    return spark.range(n).select(
        begin.alias("window_start"), (begin + F.expr(f"INTERVAL {size_s} SECONDS")).alias("window_end")
    )


def counted_windows(events: DataFrame, start: datetime, end: datetime, size_s: int, stride_s: int) -> DataFrame:
    """The window spine with the number of events in each window."""
    counts = assign_windows(events.select("time"), start, end, size_s, stride_s).groupBy("window_start").count()
    return (
        window_spine(events.sparkSession, start, end, size_s, stride_s)
        .join(counts, "window_start", "left")
        .select("window_start", "window_end", F.coalesce("count", F.lit(0)).alias("n_events"))
    )


def label_windows(windows: DataFrame, scenarios: DataFrame, unit_seconds: int = 60) -> DataFrame:
    """Label 1 and the type of the first (lowest id) scenario that overlaps a window, else 0.

    Both overlap bounds are strict. ``windows`` needs unique window_start values.
    """
    spans = scenarios.select("scenario_id", "type", "start_ts", "end_ts")
    hits = (
        overlap_pairs(
            windows.select("window_start", "window_end"), spans, ("window_start", "window_end"), ("start_ts", "end_ts"), unit_seconds
        )
        .groupBy("window_start")
        .agg(F.min_by("type", "scenario_id").alias("scenario_type"))
    )
    return windows.join(hits, "window_start", "left").withColumn(
        "label", F.col("scenario_type").isNotNull().cast("int")
    )


def temporal_split(windows: DataFrame, train_frac: float, val_frac: float, cell_seconds: int = 86_400) -> DataFrame:
    """Add ``rank`` (0-based, by window_start) and ``split`` (train, val, test) by position.

    Train and val get at least one window; if nothing is left for test, it takes the last val window.
    """
    ranked = global_rank(windows, time_cell(F.col("window_start"), cell_seconds), [F.col("window_start")])
    n = F.col("_n")
    n_train = F.greatest(F.lit(1), F.floor(n * F.lit(float(train_frac))))
    n_val = F.greatest(F.lit(1), F.floor(n * F.lit(float(val_frac))))
    val_end = F.least(n_train + n_val, n)
    val_end = F.when((val_end == n) & (n > n_train), n - 1).otherwise(val_end)
    at = F.col("rank")
    total = windows.agg(F.count("*").alias("n"))
    return (
        ranked.withColumn("rank", at - 1)
        .withColumn("_n", total.scalar())
        .withColumn("split", F.when(at < n_train, "train").when(at < val_end, "val").otherwise("test"))
        .drop("_n")
    )


def trailing_buffer(
    events: DataFrame,
    ticks: DataFrame,
    size: int = 1000,
    tick: str = "tick",
    tiebreak: str = "event_id",
    cell_seconds: int = 3_600,
) -> DataFrame:
    """The newest ``size`` events of a service at or before each of its ticks.

    Events and ticks are numbered together: a tick's number is the count of events up to it. Events
    then sit in blocks of ``size`` numbers and a tick needs two blocks, so the join is an equi-join that
    yields at most ``size`` events per tick, whatever the service's volume. Ticks are unique per service.
    """
    marks = ticks.select(
        "service", F.col(tick).alias("time"), F.lit(None).cast(events.schema[tiebreak].dataType).alias(tiebreak), F.lit(0).alias("_e")
    )
    both = events.select("service", "time", tiebreak, F.lit(1).alias("_e")).unionByName(marks)
    numbered = running_sums(
        both,
        time_cells(F.col("time"), cell_seconds),
        [F.col("time"), F.desc("_e"), F.col(tiebreak)],
        {"number": F.col("_e").cast("bigint")},
        ["service"],
    )
    block = lambda number: F.floor((number - 1) / F.lit(size)).cast("bigint")
    events_no = (
        numbered.where(F.col("_e") == 1)
        .select("service", tiebreak, "number")
        .withColumn("_block", block(F.col("number")))
    )
    last = F.col("_last")
    ticks_no = (
        numbered.where((F.col("_e") == 0) & (F.col("number") > 0))
        .select("service", F.col("time").alias(tick), F.col("number").alias("_last"))
        .withColumn("_block", F.explode(F.array_distinct(F.array(block(F.greatest(last - size + 1, F.lit(1))), block(last)))))
    )
    wanted = (
        events_no.join(ticks_no, ["service", "_block"])
        .where((F.col("number") <= last) & (F.col("number") > last - size))
        .select("service", tick, tiebreak, (last - F.col("number") + 1).alias("age"))
    )
    return wanted.join(events, ["service", tiebreak])


def event_checks(events: DataFrame, seconds: int) -> DataFrame:
    """Checks that events set off (service, tick): the first event of a service starts its clock, then each first
    event at least ``seconds`` after the last check (or the start) is a check. Nothing happens in silence.

    The check sees all events of its own instant.
    """
    moments = events.select("service", F.unix_micros("time").alias("_us"))
    chain = chained(moments, ["service"], "_us", seconds * 1_000_000)
    start = chain.groupBy("service").agg(F.min("_us").alias("_start"))
    return chain.join(start, "service").where("_us > _start").select("service", F.timestamp_micros("_us").alias("tick"))


def context_events(
    anomalies: DataFrame, events: DataFrame, minutes: int = 10, limit: int = 100, tiebreak: str = "event_id"
) -> DataFrame:
    """The newest ``limit`` events of an anomaly's service within ``minutes`` on either side of it.

    Only events in time cells an anomaly touches are kept (semi join), then the trailing-buffer plan
    picks the newest ones up to the end of the span; no all-pairs range join takes place.
    """
    seconds = minutes * 60
    span = F.expr(f"INTERVAL {minutes} MINUTES")
    spans = anomalies.select("anomaly_id", "service", (F.col("time") - span).alias("_from"), (F.col("time") + span).alias("tick"))
    cells = spans.select(
        "service", F.explode(F.sequence(time_cell(F.col("_from"), seconds), time_cell(F.col("tick"), seconds))).alias("_cell")
    ).distinct()
    near = (
        events.withColumn("_cell", time_cell(F.col("time"), seconds))
        .join(cells, ["service", "_cell"], "left_semi")
        .drop("_cell")
    )
    newest = trailing_buffer(near, spans.select("service", "tick").distinct(), limit, "tick", tiebreak)
    return (
        newest.join(spans, ["service", "tick"])
        .where(F.col("time") >= F.col("_from"))
        .drop("_from", "tick")
    )


def context_metrics(anomalies: DataFrame, metrics_5m: DataFrame, minutes: int = 10) -> DataFrame:
    """Mean of the 5-minute rollup rows within ``minutes`` of each anomaly; null where there are none."""
    span = F.expr(f"INTERVAL {minutes} MINUTES")
    spans = anomalies.select("anomaly_id", "service", (F.col("time") - span).alias("_from"), (F.col("time") + span).alias("_to"))
    hits = points_in_spans(metrics_5m, spans, "bucket", ("_from", "_to"), minutes * 60, ["service"], "inner")
    means = hits.groupBy("anomaly_id").agg(
        F.avg("event_count").alias("avg_event_count"),
        F.avg("error_rate").alias("avg_error_rate"),
        F.avg("avg_latency").alias("avg_latency"),
        F.avg("p95_latency").alias("avg_p95_latency"),
        F.avg("p99_latency").alias("avg_p99_latency"),
    )
    return anomalies.select("anomaly_id", "service").join(means, "anomaly_id", "left")
