"""Searches, listings and lookups over events, anomalies and reports, and their simple joins."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.schema import SEVERITIES


def _since(column: str, as_of: datetime, **ago: float) -> Column:
    return F.col(column) >= F.lit(as_of - timedelta(**ago))


def _after(column: str, as_of: datetime, **ago: float) -> Column:
    return F.col(column) > F.lit(as_of - timedelta(**ago))


def search_events(
    events: DataFrame,
    as_of: datetime,
    service: str | None = None,
    level: str | None = None,
    search: str | None = None,
    trace_id: str | None = None,
    hours: int = 24,
    limit: int = 100,
    tiebreak: str | None = None,
) -> DataFrame:
    """Newest events that match every given filter (``search`` is a case-blind substring pattern)."""
    found = events.where(_since("time", as_of, hours=hours))
    for name, value in (("service", service), ("level", level), ("trace_id", trace_id)):
        if value is not None:
            found = found.where(F.col(name) == value)
    if search is not None:
        found = found.where(F.ilike(F.col("message"), F.lit(f"%{search}%")))
    order = [F.desc("time"), *([F.desc(tiebreak)] if tiebreak else [])]
    return found.orderBy(*order).limit(limit)


def _anomaly_fields(anomalies: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    return anomalies.select(
        "time",
        "anomaly_id",
        "service",
        F.coalesce("score", zero).alias("score"),
        F.coalesce("threshold", zero).alias("threshold"),
        "severity",
        "features",
        F.coalesce("confidence", zero).alias("confidence"),
        F.coalesce("is_resolved", F.lit(False)).alias("is_resolved"),
        "resolved_at",
    )


def list_anomalies(
    anomalies: DataFrame,
    as_of: datetime,
    service: str | None = None,
    severity: str | None = None,
    is_resolved: bool | None = None,
    days: int = 7,
    limit: int = 100,
) -> DataFrame:
    found = anomalies.where(_since("time", as_of, days=days))
    for name, value in (("service", service), ("severity", severity), ("is_resolved", is_resolved)):
        if value is not None:
            found = found.where(F.col(name) == F.lit(value))
    return _anomaly_fields(found).orderBy(F.desc("time"), "anomaly_id").limit(limit)


def anomaly_by_id(anomalies: DataFrame, anomaly_id: str) -> DataFrame:
    return _anomaly_fields(anomalies.where(F.col("anomaly_id") == anomaly_id))


def report_by_id(reports: DataFrame, documents: DataFrame, report_id: str) -> DataFrame:
    """Stored metadata of one report with its document text."""
    one = F.col("report_id") == report_id
    return reports.where(one).drop("content").join(documents.where(one).select("report_id", "content"), "report_id", "left")


def list_reports(reports: DataFrame, service: str | None = None, limit: int = 10) -> DataFrame:
    """Newest reports; ``service`` is looked for inside the report id."""
    found = reports if service is None else reports.where(F.col("report_id").contains(service))
    return found.orderBy(F.desc("generated_at"), "report_id").limit(limit)


def recent_reports(reports: DataFrame, limit: int = 10) -> DataFrame:
    return (
        reports.select(
            "report_id", "service", "severity", "model", "tokens_used", F.round("cost_usd", 4).alias("cost"), "generated_at"
        )
        .orderBy(F.desc("generated_at"), "report_id")
        .limit(limit)
    )


def resolve_anomalies(anomalies: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Apply a table of (anomaly_id, resolved_at); the latest resolution of an id wins."""
    latest = resolutions.groupBy("anomaly_id").agg(F.max("resolved_at").alias("_at"))
    return (
        anomalies.join(latest, "anomaly_id", "left")
        .withColumn("is_resolved", F.col("_at").isNotNull() | F.coalesce("is_resolved", F.lit(False)))
        .withColumn("resolved_at", F.coalesce("_at", "resolved_at"))
        .drop("_at")
    )


def anomalies_with_top_feature(anomalies: DataFrame, as_of: datetime, limit: int = 20) -> DataFrame:
    """Anomalies of the last 24 h that carry attributions, with the first-ranked feature."""
    top = F.get("features.top_features", F.lit(0))
    return (
        anomalies.where(_after("time", as_of, hours=24) & F.col("features.top_features").isNotNull())
        .select(
            "time",
            "anomaly_id",
            "service",
            "severity",
            F.round("score", 3).alias("score"),
            top["name"].alias("top_feature"),
            F.round(top["value"], 3).alias("value"),
            F.round(top["shap"], 3).alias("shap"),
            top["direction"].alias("direction"),
        )
        .orderBy(F.desc("time"), "anomaly_id")
        .limit(limit)
    )


def recent_critical_anomalies(anomalies: DataFrame, reports: DataFrame, as_of: datetime) -> DataFrame:
    """HIGH and CRITICAL anomalies of the last 24 h with their report, if any."""
    serious = anomalies.where(F.col("severity").isin(*SEVERITIES[2:]) & _after("time", as_of, hours=24))
    return serious.select(
        "time", "service", "anomaly_id", "score", "severity", "confidence", "is_resolved"
    ).join(reports.select("anomaly_id", "report_id", "s3_location"), "anomaly_id", "left")


def anomalies_without_report(anomalies: DataFrame, reports: DataFrame, limit: int | None = 20) -> DataFrame:
    left = anomalies.join(reports.select("anomaly_id"), "anomaly_id", "left_anti").orderBy("time", "anomaly_id")
    return left if limit is None else left.limit(limit)


def recent_anomalies_per_service(anomalies: DataFrame, limit: int = 5) -> DataFrame:
    """The newest anomalies of each service. The rank filter is applied per task before the shuffle."""
    order = Window.partitionBy("service").orderBy(F.desc("time"), "anomaly_id")
    return anomalies.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
