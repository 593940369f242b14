"""Window features (27 columns), scaling, and the rule detector's input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.functions.scalars import is_error, safe_ratio
from vigilspark.plans.ordering import exact_percentiles
from vigilspark.schema import ERROR_LEVELS, FEATURE_NAMES, KNOWN_SERVICES, service_columns

_ALL = "*"


def derived_features(
    count: Column, error_rate: Column, p50: Column, p95: Column, p99: Column
) -> dict[str, Column]:
    """Features computed from other features."""
    return {
        "p95_p50_ratio": p95 / (p50 + 1),
        "p99_p95_ratio": p99 / (p95 + 1),
        "error_count": count.cast("double") * error_rate,
        "log_event_count": F.log1p(count.cast("double")),
        "log_error_rate": F.log1p(error_rate * 1000),
    }


def window_features(
    rows: DataFrame,
    keys: Sequence[str] = ("window_start", "window_end"),
    min_events: int = 10,
    weight: str | None = None,
) -> DataFrame:
    """One row of 27 features per window; windows with fewer than ``min_events`` events are left out.

    ``rows`` holds each event once per window with ``service``, ``level`` and ``valid_latency``.
    Counts come from one grouped pass; percentiles of the whole window and of each known service come
    from one exact percentile plan over (window, scope).
    """
    keys = list(keys)
    n = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    rows = rows.select(*keys, "service", "level", "valid_latency", n.alias("n"))
    bad = "level IN ('" + "', '".join(ERROR_LEVELS) + "')"
    measured = "sum(CASE WHEN valid_latency IS NOT NULL THEN n END)"
    per_service = [
        F.expr(f"sum(CASE WHEN service = '{s}' {extra} THEN n ELSE 0 END) AS `{name}_{s}`")
        for s in KNOWN_SERVICES
        for name, extra in (("_n", ""), ("_e", f"AND {bad}"))
    ]
    spread = [F.stddev_pop("valid_latency").alias("_std")] if weight is None else []
    base = (
        rows.groupBy(*keys)
        .agg(
            F.sum("n").alias("event_count"),
            F.expr(f"sum(CASE WHEN {bad} THEN n ELSE 0 END) AS _errors"),
            F.expr(f"{measured} AS _m"),
            F.expr(f"try_divide(sum(valid_latency * n), CAST({measured} AS DOUBLE)) AS _mean"),
            *spread,
            *per_service,
        )
        .where(F.col("event_count") >= min_events)
    )
    if weight is not None:
        deviation = F.pow(F.col("valid_latency") - F.col("_mean"), 2) * F.col("n")
        base = base.join(
            rows.join(base.select(*keys, "_mean", "_m"), keys)
            .groupBy(*keys)
            .agg(F.sqrt(F.try_divide(F.sum(deviation), F.first("_m"))).alias("_std")),
            keys,
        )
    scoped = rows.withColumn("_scope", F.explode(F.array(F.lit(_ALL), F.col("service")))).where(
        F.col("_scope").isin(_ALL, *KNOWN_SERVICES)
    )
    tails = exact_percentiles(scoped, [*keys, "_scope"], "valid_latency", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, "n")

    def of(scope: str, source: str, name: str) -> Column:
        return F.expr(f"coalesce(max(CASE WHEN _scope = '{scope}' THEN {source} END), 0.0D) AS `{name}`")

    wide = tails.groupBy(*keys).agg(
        *[of(_ALL, p, f"{p}_latency_ms") for p in ("p50", "p95", "p99")],
        *[of(s, "p95", service_columns(s)[1]) for s in KNOWN_SERVICES],
    )
    rates = [
        F.expr(f"coalesce(try_divide(CAST(`_e_{s}` AS DOUBLE), CAST(`_n_{s}` AS DOUBLE)), 0.0D) AS `{service_columns(s)[0]}`")
        for s in KNOWN_SERVICES
    ]
    measures = [
        F.expr(f"coalesce(`{c}`, 0.0D) AS `{c}`")
        for c in ("p50_latency_ms", "p95_latency_ms", "p99_latency_ms", *[service_columns(s)[1] for s in KNOWN_SERVICES])
    ]
    joined = base.join(wide, keys, "left").select(
        *keys,
        F.col("event_count").cast("double").alias("event_count"),
        F.expr("coalesce(try_divide(CAST(_errors AS DOUBLE), CAST(event_count AS DOUBLE)), 0.0D) AS error_rate"),
        F.expr("coalesce(_std, 0.0D) AS latency_std"),
        *measures,
        *rates,
    )
    extra = derived_features(
        F.col("event_count"), F.col("error_rate"), F.col("p50_latency_ms"), F.col("p95_latency_ms"), F.col("p99_latency_ms")
    )
    return joined.select(
        *keys, *[extra[f].alias(f) if f in extra else F.col(f"`{f}`") for f in FEATURE_NAMES]
    )


def service_features(rows: DataFrame, keys: Sequence[str] = ("window_start", "window_end")) -> DataFrame:
    """Error rate and p95 latency per window and service in long form, for any service."""
    by = [*keys, "service"]
    base = rows.groupBy(*by).agg(F.count("*").alias("event_count"), F.avg(is_error().cast("double")).alias("error_rate"))
    tails = exact_percentiles(rows, by, "valid_latency", {"p95_latency": 0.95})
    return base.join(tails, by, "left").na.fill(0.0, ["p95_latency"])


def unpivot_features(features: DataFrame, keys: Sequence[str], names: Sequence[str] = FEATURE_NAMES) -> DataFrame:
    """Feature columns to (keys, feature, value) rows."""
    return features.unpivot(list(keys), [f"`{n}`" for n in names], "feature", "value")


def fit_scaler(features: DataFrame, names: Sequence[str] = FEATURE_NAMES) -> DataFrame:
    """One row: a struct of mean and scale per feature (population deviation, zero becomes 1)."""
    stats = features.agg(
        *[
            F.expr(
                f"struct(avg(`{n}`) AS mean, CASE WHEN stddev_pop(`{n}`) = 0 THEN 1.0D ELSE stddev_pop(`{n}`) END AS scale) AS `{n}`"
            )
            for n in names
        ]
    )
    return stats.select(F.struct("*").alias("scaler"))


def scale(features: DataFrame, scaler: DataFrame, names: Sequence[str] = FEATURE_NAMES) -> DataFrame:
    """Replace feature columns by their scaled values; the one-row scaler is a scalar subquery."""
    rest = [c for c in features.columns if c not in names]
    s = features.withColumn("_s", scaler.select("scaler").scalar())
    return s.select(
        *rest,
        *[F.expr(f"(`{n}` - _s.`{n}`.mean) / _s.`{n}`.scale AS `{n}`") for n in names],
    )


def vector(names: Sequence[str] = FEATURE_NAMES) -> Column:
    return F.array(*[F.col(f"`{n}`") for n in names])
