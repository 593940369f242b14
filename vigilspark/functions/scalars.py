"""Column expressions used by several operators (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.schema import ERROR_LEVELS


def is_error(level: Column | str = "level") -> Column:
    """ERROR and CRITICAL together, the definition features, health and dashboards use."""
    level = F.col(level) if isinstance(level, str) else level
    return level.isin(*ERROR_LEVELS)


def safe_ratio(numerator: Column, denominator: Column, default: float | None = 0.0) -> Column:
    """``numerator / denominator`` in DOUBLE; ``default`` where the denominator is zero."""
    ratio = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return ratio if default is None else F.coalesce(ratio, F.lit(float(default)))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Difference in seconds that keeps microseconds."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def iso_timestamp(text: Column | str) -> Column:
    """ISO-8601 text to TIMESTAMP: ``Z`` and offsets honoured, naive stamps are session time (UTC)."""
    text = F.col(text) if isinstance(text, str) else text
    return F.try_to_timestamp(text)


def with_metadata_fields(df: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Typed columns from the JSON ``metadata`` text.

    ``has_latency``    the key is present (a JSON null counts)
    ``latency_ms``     numbers and numeric text, the rollup's reading of the field
    ``valid_latency``  only JSON numbers (and true, which counts as 1) above zero, the features' reading
    ``endpoint``       text of the endpoint key

    Events that have these columns already (``enrich`` sets them) are returned as they are.
    """
    if "has_latency" in df.columns:
        return df
    parsed = F.col("_json")  # a column of its own, so the text is parsed once
    fields = F.struct(
        F.schema_of_variant(F.variant_get(parsed, "$.latency_ms", "variant")).alias("_kind"),
        F.try_variant_get(parsed, "$.latency_ms", "double").alias("_number"),
        F.try_variant_get(parsed, "$.endpoint", "string").alias("endpoint"),
    )
    # inline() keeps later filters above the extraction; pushed below it they would parse the text again
    extracted = df.withColumn("_json", F.try_parse_json(F.col(metadata))).select(*df.columns, F.inline(F.array(fields)))
    kind, number = F.col("_kind"), F.col("_number")
    return extracted.select(
        *df.columns,
        kind.isNotNull().alias("has_latency"),
        F.when(kind != "BOOLEAN", number).alias("latency_ms"),
        F.when((kind != "STRING") & (number > 0), number).alias("valid_latency"),
        "endpoint",
    )


def direction(shap: Column) -> Column:
    """Negative attributions pull the score down, toward anomaly."""
    return F.when(shap < 0, F.lit("toward_anomaly")).otherwise(F.lit("toward_normal"))


def truncate(text: Column, limit: int = 100) -> Column:
    """Messages over ``limit`` characters keep ``limit - 3`` and end in three dots."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def in_buckets(time: Column | str, width: str) -> Column:
    """Start of the epoch-aligned bucket of ``width`` that holds ``time``."""
    time = F.col(time) if isinstance(time, str) else time
    return F.window(time, width).getField("start")
