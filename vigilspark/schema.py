"""Canonical schemas and the fixed value lists shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Stored data and trained models depend on these exact strings
# and on their order.
# ---------------------------------------------------------------------------
KNOWN_SERVICES = (
    "api-gateway",
    "auth-service",
    "user-service",
    "payment-service",
    "inventory-service",
    "notification-service",
    "recommendation-engine",
    "search-service",
)
LEVELS = ("DEBUG", "INFO", "WARN", "ERROR", "CRITICAL")
ERROR_LEVELS = ("ERROR", "CRITICAL")
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
GLOBAL_FEATURES = (
    "event_count",
    "error_rate",
    "p50_latency_ms",
    "p95_latency_ms",
    "p99_latency_ms",
    "latency_std",
    "p95_p50_ratio",
    "p99_p95_ratio",
    "error_count",
    "log_event_count",
    "log_error_rate",
)
SERIES_FEATURES = (
    "event_count",
    "error_rate",
    "p50_latency_ms",
    "p95_latency_ms",
    "p99_latency_ms",
    "latency_std",
    "hour_of_day",
    "p95_p50_ratio",
    "p99_p95_ratio",
    "error_count",
    "log_event_count",
    "log_error_rate",
)
# (model, USD per million input tokens, USD per million output tokens, is provider default)
MODEL_PRICES = (
    ("gemini-1.5-flash", 0.075, 0.30, True),
    ("gemini-1.5-flash-8b", 0.0375, 0.15, False),
    ("gemini-1.5-pro", 1.25, 5.00, False),
    ("claude-3-5-sonnet-20241022", 3.00, 15.00, True),
    ("claude-3-5-haiku-20241022", 1.00, 5.00, False),
)
# ---------------------------------------------------------------------------


def service_columns(service: str) -> tuple[str, str]:
    """The two feature columns of one service."""
    return f"{service}_error_rate", f"{service}_p95_latency"


SERVICE_FEATURES = tuple(c for s in KNOWN_SERVICES for c in service_columns(s))
FEATURE_NAMES = GLOBAL_FEATURES + SERVICE_FEATURES

EVENT = T.StructType(
    [
        T.StructField("time", T.TimestampType()),
        T.StructField("service", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("span_id", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("ingested_at", T.TimestampType()),
        # set at ingest: a name from the content, and what is read from the metadata
        T.StructField("event_id", T.LongType()),
        T.StructField("has_latency", T.BooleanType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("valid_latency", T.DoubleType()),
        T.StructField("endpoint", T.StringType()),
    ]
)

# The wire form: metadata is any JSON object, kept as text by the JSON reader.
WIRE_EVENT = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("span_id", T.StringType()),
    ]
)

TOP_FEATURE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("shap", T.DoubleType()),
        T.StructField("direction", T.StringType()),
    ]
)

FEATURES_PAYLOAD = T.StructType(
    [
        T.StructField("values", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("top_features", T.ArrayType(TOP_FEATURE)),
        T.StructField("window_size", T.LongType()),
        T.StructField("window_start", T.TimestampType()),
        T.StructField("window_end", T.TimestampType()),
    ]
)

TIMELINE = T.StructType(
    [
        T.StructField("start_utc", T.StringType()),
        T.StructField("end_utc", T.StringType()),
        T.StructField("services", T.ArrayType(T.StringType())),
        T.StructField(
            "scenarios",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("type", T.StringType()),
                        T.StructField("targets", T.ArrayType(T.StringType())),
                        T.StructField("start_utc", T.StringType()),
                        T.StructField("end_utc", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)

INCIDENT_REPORT = T.StructType(
    [
        T.StructField("incident_id", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("detected_at", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("executive_summary", T.StringType()),
        T.StructField("root_cause_hypothesis", T.StringType()),
        T.StructField("contributing_features", T.ArrayType(TOP_FEATURE)),
        T.StructField(
            "recommended_actions",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("timeframe", T.StringType()),
                        T.StructField("action", T.StringType()),
                        T.StructField("rationale", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("monitoring_checks", T.ArrayType(T.StringType())),
    ]
)
