"""Grouped metrics: rollups, health, dashboards, rates, histogram quantiles and log summaries."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.functions.scalars import in_buckets, is_error, safe_ratio, seconds_between
from vigilspark.plans.ordering import exact_percentiles, values_at_ranks


def rollup(events: DataFrame, width: str, weight: str | None = None) -> DataFrame:
    """Rollup per (bucket, service) over events that carry a latency key.

    Needs the columns of ``with_metadata_fields``. ``error_rate`` counts ERROR only, CRITICAL has its
    own rate; the deviation is the sample form. ``weight`` (a row count) lets pre-counted cells be
    rolled up, which the streaming form uses.
    """
    n = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    rows = events.where("has_latency").select(
        in_buckets("time", width).alias("bucket"), "service", "level", "latency_ms", "endpoint", n.alias("n")
    )
    keys = ["bucket", "service"]
    measured = F.when(F.col("latency_ms").isNotNull(), F.col("n"))
    spread = [F.stddev_samp("latency_ms").alias("latency_stddev")] if weight is None else []
    base = rows.groupBy(*keys).agg(
        F.sum("n").alias("event_count"),
        safe_ratio(F.sum(F.col("latency_ms") * F.col("n")), F.sum(measured), None).alias("avg_latency"),
        F.sum(measured).alias("_m"),
        F.sum(F.when(F.col("level") == "ERROR", F.col("n")).otherwise(0)).alias("_errors"),
        F.sum(F.when(F.col("level") == "CRITICAL", F.col("n")).otherwise(0)).alias("_critical"),
        F.count_distinct("endpoint").alias("unique_endpoints"),
        *spread,
    )
    if weight is not None:
        deviation = F.pow(F.col("latency_ms") - F.col("avg_latency"), 2) * F.col("n")
        squares = (
            rows.join(base.select(*keys, "avg_latency", "_m"), keys)
            .groupBy(*keys)
            .agg(F.sqrt(F.try_divide(F.sum(deviation), F.first("_m") - 1)).alias("latency_stddev"))
        )
        base = base.join(squares, keys)
    tails = exact_percentiles(rows, keys, "latency_ms", {"p95_latency": 0.95, "p99_latency": 0.99}, "n")
    return (
        base.join(tails, keys, "left")
        .select(
            *keys,
            "event_count",
            "avg_latency",
            "p95_latency",
            "p99_latency",
            "latency_stddev",
            safe_ratio(F.col("_errors"), F.col("event_count"), None).alias("error_rate"),
            safe_ratio(F.col("_critical"), F.col("event_count"), None).alias("critical_rate"),
            "unique_endpoints",
        )
    )


def export_metrics(events: DataFrame, as_of: datetime, width: str = "5 minutes", days: int = 7) -> DataFrame:
    """Windowed metrics of the last days for the CSV export: all events count, errors as a mean."""
    rows = events.where(F.col("time") > F.lit(as_of - timedelta(days=days))).select(
        in_buckets("time", width).alias("window"), "service", "level", "latency_ms"
    )
    keys = ["window", "service"]
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("event_count"), F.avg((F.col("level") == "ERROR").cast("double")).alias("error_rate")
    )
    tails = exact_percentiles(
        rows, keys, "latency_ms", {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95, "p99_latency_ms": 0.99}
    )
    return base.join(tails, keys, "left")


def anomaly_summary(anomalies: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    return (
        anomalies.where(F.col("time") > F.lit(as_of - timedelta(days=days)))
        .groupBy("service", "severity")
        .agg(
            F.count("*").alias("total_anomalies"),
            F.avg("score").alias("avg_score"),
            F.min("time").alias("first_occurrence"),
            F.max("time").alias("last_occurrence"),
            F.count_if("is_resolved").alias("resolved_count"),
            F.count_if(~F.col("is_resolved")).alias("open_count"),
        )
        .orderBy(F.desc("total_anomalies"), "service", "severity")
    )


def service_stats(events: DataFrame, as_of: datetime, minutes: int = 5) -> DataFrame:
    """Event count, combined error rate and mean latency per service over the last minutes."""
    return (
        events.where(F.col("time") >= F.lit(as_of - timedelta(minutes=minutes)))
        .groupBy("service")
        .agg(
            F.count("*").alias("event_count"),
            F.avg(is_error().cast("double")).alias("error_rate"),
            F.avg("latency_ms").alias("avg_latency"),
        )
    )


def open_anomalies(anomalies: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    return (
        anomalies.where((F.col("time") >= F.lit(as_of - timedelta(hours=hours))) & ~F.col("is_resolved"))
        .groupBy("service")
        .agg(F.count("*").alias("active_anomalies"))
    )


def service_health(events: DataFrame, anomalies: DataFrame, as_of: datetime, minutes: int = 5) -> DataFrame:
    """Stats and open anomalies per recently active service, with its health class."""
    rate, n = F.col("error_rate"), F.col("active_anomalies")
    return (
        service_stats(events, as_of, minutes)
        .join(open_anomalies(anomalies, as_of), "service", "left")
        .na.fill(0, ["active_anomalies"])
        .na.fill(0.0, ["error_rate", "avg_latency"])
        .withColumn(
            "status",
            F.when((rate > 0.1) | (n > 5), "critical").when((rate > 0.05) | (n > 2), "degraded").otherwise("healthy"),
        )
    )


def ingest_delay_ms() -> Column:
    return seconds_between(F.col("ingested_at"), F.col("time")) * 1000


def events_by_service(events: DataFrame, as_of: datetime, hours: int = 1) -> DataFrame:
    return (
        events.where((F.col("time") > F.lit(as_of - timedelta(hours=hours))) & F.col("ingested_at").isNotNull())
        .groupBy("service")
        .agg(
            F.count("*").alias("event_count"),
            F.count_if(is_error()).alias("errors"),
            F.round(F.avg(ingest_delay_ms()), 2).alias("avg_delay_ms"),
        )
        .orderBy(F.desc("event_count"), "service")
    )


def counts_by(events: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return events.groupBy(*keys).agg(F.count("*").alias(name))


def counts_per_bucket(rows: DataFrame, width: str, keys: Sequence[str] = (), name: str = "n") -> DataFrame:
    """Row counts per time bucket, also for a finer split by ``keys``."""
    return rows.groupBy(in_buckets("time", width).alias("bucket"), *keys).agg(F.count("*").alias(name))


def ingest_delay_per_bucket(events: DataFrame, width: str = "1 minute") -> DataFrame:
    return (
        events.where(F.col("ingested_at").isNotNull())
        .groupBy(in_buckets("time", width).alias("bucket"))
        .agg(F.avg(ingest_delay_ms()).alias("avg_delay_ms"))
    )


def report_totals(reports: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    return reports.where(F.col("generated_at") > F.lit(as_of - timedelta(hours=hours))).agg(
        F.count("*").alias("reports_generated"),
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 4).alias("total_cost"),
        F.coalesce(F.sum("tokens_used"), F.lit(0)).cast("bigint").alias("total_tokens"),
    )


def top_feature_counts(anomalies: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    return (
        anomalies.where(F.col("time") > F.lit(as_of - timedelta(hours=hours)))
        .where(F.col("features.top_features").isNotNull())
        .groupBy(F.get("features.top_features", F.lit(0))["name"].alias("feature"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "feature")
    )


def table_stats(events: DataFrame, anomalies: DataFrame, reports: DataFrame) -> DataFrame:
    """One labelled count per row."""

    def row(label: str, df: DataFrame, value: Column) -> DataFrame:
        return df.agg(value.cast("bigint").alias("n")).select(F.lit(label).alias("label"), "n")

    return (
        row("total_events", events, F.count("*"))
        .unionByName(row("total_anomalies", anomalies, F.count("*")))
        .unionByName(row("total_reports", reports, F.count("*")))
        .unionByName(row("services", events, F.count_distinct("service")))
    )


def request_log_summary(
    log: DataFrame,
    duration_seconds: float,
    target_rate: float = 50_000.0,
    target_p99: float = 150.0,
    target_success: float = 99.9,
) -> DataFrame:
    """Totals, nearest-rank percentiles and verdicts of a request log (elapsed DOUBLE, success BOOLEAN).

    The percentile is the value at 0-based index ``int(n * q)`` of the sorted log (p50: the median).
    """
    n = F.col("total")
    totals = log.agg(
        F.count("*").alias("total"),
        F.count_if("success").alias("ok"),
        F.count_if(~F.col("success")).alias("failed"),
        F.avg("elapsed").alias("avg_latency"),
    )
    picked = values_at_ranks(
        log,
        [],
        "elapsed",
        {
            "_low": lambda n: F.floor((n - 1) / 2),
            "_high": lambda n: F.ceil((n - 1) / 2),
            "p95_latency": lambda n: F.floor(n * 0.95),
            "p99_latency": lambda n: F.floor(n * 0.99),
        },
    ).select(((F.col("_low") + F.col("_high")) / 2).alias("p50_latency"), "p95_latency", "p99_latency")
    summary = totals.withColumn("_p", picked.select(F.struct("*")).scalar()).select(*totals.columns, "_p.*")
    return (
        summary.withColumn("success_rate", safe_ratio(F.col("ok"), n) * 100)
        .withColumn("rate", n / F.lit(float(duration_seconds)))
        .withColumn("rate_ok", F.col("rate") >= target_rate * 0.95)
        .withColumn("p99_ok", F.col("p99_latency") <= target_p99)
        .withColumn("success_ok", F.col("success_rate") >= target_success)
    )


def histogram_quantiles(
    rows: DataFrame, value: str, bounds: Sequence[float], quantiles: Sequence[float], keys: Sequence[str] = ()
) -> DataFrame:
    """Quantiles from cumulative bucket counts with linear interpolation inside the bucket found.

    A rank in the bucket above the highest bound gives that bound; the lowest bucket starts at 0
    when its bound is positive.
    """
    keys = list(keys)
    edges = F.array(*[F.lit(float(b)) for b in bounds])
    slot = F.size(F.filter(edges, lambda b: b < F.col(value)))
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, slot.alias("slot")).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy("slot")
    running = (
        counts.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
        .withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
        .withColumn("target", F.col("q") * F.col("total"))
        .where((F.col("upto") >= F.col("target")) & (F.col("upto") - F.col("n") < F.col("target")))
    )
    top = len(bounds)
    upper = F.get(edges, F.least("slot", F.lit(top - 1)))
    lower = F.when(F.col("slot") == 0, F.least(F.lit(0.0), upper)).otherwise(F.get(edges, F.col("slot") - 1))
    inner = lower + (upper - lower) * (F.col("target") - (F.col("upto") - F.col("n"))) / F.col("n")
    result = F.when(F.col("slot") == top, F.lit(float(bounds[-1]))).otherwise(inner)
    return running.select(*keys, "q", result.alias("value"))


def error_rate_trailing(events: DataFrame, as_of: datetime) -> DataFrame:
    """Error share in percent over the last 5 minutes and the event total of the last hour."""
    recent = F.col("time") > F.lit(as_of - timedelta(minutes=5))
    return events.where(F.col("time") > F.lit(as_of - timedelta(hours=1))).agg(
        (
            safe_ratio(F.count_if(recent & is_error()), F.count_if(recent), None) * 100
        ).alias("error_rate_pct"),
        F.count("*").alias("events_last_hour"),
    )


def trailing_rates(counts: DataFrame, keys: Sequence[str], frames: dict[str, int], bucket: str = "bucket") -> DataFrame:
    """Per-second rates over trailing frames (seconds) of per-minute counts, and the running total per key.

    The input is already reduced to one row per key and minute, so a key's rows are bounded by the clock.
    """
    clock = F.unix_timestamp(bucket)
    order = Window.partitionBy(*keys).orderBy(clock)
    out = counts
    for name, seconds in frames.items():
        frame = order.rangeBetween(-(seconds - 1), 0)
        out = out.withColumn(name, F.sum("n").over(frame) / F.lit(float(seconds)))
    return out.withColumn("running_total", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
