"""Labelled series: (stream, i, ts, metric, value, label) rows to z-scores, index windows and 12 features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.functions.scalars import safe_ratio
from vigilspark.operators.features import derived_features
from vigilspark.plans.intervals import points_in_spans
from vigilspark.plans.ordering import exact_percentiles, global_rank
from vigilspark.schema import SERIES_FEATURES


def label_points(points: DataFrame, spans: DataFrame, cell_seconds: int = 86_400) -> DataFrame:
    """Label 1 for points inside (bounds inclusive) any span of their stream."""
    inside = points_in_spans(
        points.select("stream", "i", "ts").distinct(), spans.select("stream", "span_start", "span_end"),
        "ts", ("span_start", "span_end"), cell_seconds, ["stream"], "inner",
    ).select("stream", "i").distinct()
    return points.join(inside.withColumn("_in", F.lit(1)), ["stream", "i"], "left").withColumn(
        "label", F.coalesce("_in", F.lit(0))
    ).drop("_in")


def join_labels(series: DataFrame, labels: DataFrame) -> DataFrame:
    """Series rows with the label vector; the inner join cuts both to the shorter."""
    return series.drop("label").join(labels.select("stream", "i", "label"), ["stream", "i"])


def zscore(series: DataFrame) -> DataFrame:
    """Value minus the mean over the population deviation of its stream and metric; zero deviation becomes 1."""
    stats = series.groupBy("stream", "metric").agg(F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_std"))
    scale = F.when(F.col("_std") == 0, F.lit(1.0)).otherwise(F.col("_std"))
    return (
        series.join(stats, ["stream", "metric"])
        .withColumn("value", (F.col("value") - F.col("_mean")) / scale)
        .drop("_mean", "_std")
    )


def value_cutoff(normalized: DataFrame, quantile: float = 0.95) -> DataFrame:
    """One row: the quantile of absolute z-scores; infinity without input."""
    sized = normalized.select(F.abs("value").alias("size"))
    return exact_percentiles(sized, [], "size", {"cutoff": quantile}).select(
        F.coalesce("cutoff", F.lit(float("inf"))).alias("cutoff")
    )


def split_streams(series: DataFrame, seed: int, train_frac: float = 0.6, val_frac: float = 0.2) -> DataFrame:
    """(stream, split): a seeded shuffle of the stream names cut by fraction."""
    names = series.select("stream").distinct().withColumn("_h", F.md5(F.concat_ws(":", "stream", F.lit(str(seed)))))
    cell = F.conv(F.substring("_h", 1, 4), 16, 10).cast("bigint")
    ranked = global_rank(names, cell, [F.col("_h"), F.col("stream")], "_r")
    counted = ranked.withColumn("_n", names.agg(F.count("*").alias("n")).scalar())
    n_train = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(train_frac)))
    n_val = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(val_frac)))
    at = F.col("_r") - 1
    return counted.select(
        "stream", F.when(at < n_train, "train").when(at < n_train + n_val, "val").otherwise("test").alias("split")
    )


def index_windows(series: DataFrame, size: int = 60, stride: int = 30) -> DataFrame:
    """Each row once per index window [wid*stride, wid*stride + size) that holds it; partial tails are dropped."""
    lengths = series.groupBy("stream").agg((F.max("i") + 1).alias("_n"))
    low = F.greatest(F.lit(0), F.ceil((F.col("i") - size + 1) / stride)).cast("bigint")
    high = F.least(F.floor(F.col("i") / stride), F.floor((F.col("_n") - size) / stride)).cast("bigint")
    return (
        series.join(lengths, "stream")
        .where((F.col("_n") >= size) & (low <= high))
        .withColumn("wid", F.explode(F.sequence(low, high)))
        .withColumn("start_i", F.col("wid") * stride)
        .withColumn("end_i", F.col("wid") * stride + size)
        .drop("_n")
    )


def series_features(normalized: DataFrame, cutoff: DataFrame, size: int = 60, stride: int = 30) -> DataFrame:
    """12 features per index window, values of all metrics pooled; label 1 if any point is labelled.

    The error rate is the share of absolute z-scores above the cutoff. Non-finite values are dropped.
    """
    keys = ["stream", "wid"]
    rows = index_windows(normalized, size, stride).withColumn(
        "value", F.when(F.abs("value") < float("inf"), F.nanvl("value", F.lit(None).cast("double")))
    ).withColumn("_cut", cutoff.scalar())
    middle = F.floor((F.col("start_i") + F.col("end_i")) / 2)
    base = rows.groupBy(*keys).agg(
        F.first(F.col("end_i") - F.col("start_i")).alias("event_count"),
        safe_ratio(F.count_if(F.abs("value") > F.col("_cut")), F.count("value")).alias("error_rate"),
        F.stddev_pop("value").alias("latency_std"),
        F.max(F.when(F.col("i") == middle, F.hour("ts"))).cast("double").alias("hour_of_day"),
        F.max("label").alias("label"),
        F.percentile("value", F.array(*[F.lit(p) for p in (0.5, 0.95, 0.99)])).alias("_tails"),  # a group has ``size`` rows a metric
    )
    names = ("p50_latency_ms", "p95_latency_ms", "p99_latency_ms")
    joined = base.where(F.col("_tails").isNotNull()).withColumns({n: F.get("_tails", F.lit(i)) for i, n in enumerate(names)})
    extra = derived_features(
        F.col("event_count"), F.col("error_rate"), F.col("p50_latency_ms"), F.col("p95_latency_ms"), F.col("p99_latency_ms")
    )
    computed = {"event_count": F.col("event_count").cast("double"), **extra}
    return joined.select(*keys, *[computed.get(f, F.col(f)).alias(f) for f in SERIES_FEATURES], "label")
