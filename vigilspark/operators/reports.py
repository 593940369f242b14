"""Incident context, report texts, response parsing and cost."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilspark.functions.scalars import is_error, truncate
from vigilspark.operators.listing import recent_anomalies_per_service
from vigilspark.operators.windows import context_events, context_metrics
from vigilspark.schema import INCIDENT_REPORT, MODEL_PRICES, SEVERITIES

# Fixed values of a record whose response could not be parsed.
FALLBACK_CONFIDENCE = 0.5
FALLBACK_CHARS = 1000
FALLBACK_EMPTY = "LLM returned no content."
FALLBACK_CAUSE = "Structured parse failed; see executive summary for the raw model output."
# Fixed pattern: a fence line at the start or end of a line.
FENCE = r"(?m)^```(?:json)?\s*|\s*```$"


def report_context(
    anomalies: DataFrame,
    events: DataFrame,
    metrics_5m: DataFrame,
    history: DataFrame | None = None,
    minutes: int = 10,
    max_events: int = 100,
    tiebreak: str = "event_id",
) -> DataFrame:
    """One row per anomaly: its context events (newest first), metric means, and the service's newest anomalies.

    The arrays are bounded: at most ``max_events`` events and five recent anomalies.
    """
    near = context_events(anomalies.select("anomaly_id", "service", "time"), events, minutes, max_events, tiebreak)
    event = F.struct("age", tiebreak, "time", "service", "level", "message", "trace_id")
    packed = near.groupBy("anomaly_id").agg(F.array_sort(F.collect_list(event)).alias("events"))
    means = context_metrics(anomalies, metrics_5m, minutes).drop("service")
    recent = (
        recent_anomalies_per_service(history if history is not None else anomalies)
        .groupBy("service")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "time", "severity", "score"))).alias("recent_anomalies"))
    )
    empty = F.array().cast(T.ArrayType(T.StringType()))
    joined = anomalies.join(packed, "anomaly_id", "left").join(means, "anomaly_id", "left").join(recent, "service", "left")
    errors = F.size(F.filter(F.col("events"), lambda e: is_error(e["level"])))
    return joined.withColumn("error_events", F.coalesce(errors, F.lit(0))).withColumn(
        "context_events", F.coalesce(F.size("events"), F.size(empty))
    )


def report_fields(context: DataFrame) -> DataFrame:
    """The values a report shows: nulls become zero, severity is one of the four classes (else LOW)."""
    upper = F.upper(F.coalesce("severity", F.lit("LOW")))
    return context.select(
        "anomaly_id",
        "service",
        F.col("time").alias("detected_at"),
        F.when(upper.isin(*SEVERITIES), upper).otherwise("LOW").alias("severity"),
        "score",
        F.coalesce("avg_error_rate", F.lit(0.0)).alias("error_rate"),
        F.coalesce(F.col("avg_event_count").cast("bigint"), F.lit(0)).alias("total_events"),
        "error_events",
        F.coalesce("avg_latency", F.lit(0.0)).alias("avg_latency"),
        F.coalesce("avg_p99_latency", F.lit(0.0)).alias("p99_latency"),
    )


def _fixed(value: Column | str, digits: int, sign: str = "") -> Column:
    """A number with ``digits`` decimals, rounded half up; noise beyond the sixth decimal doesn't count, null stays null."""
    rounded = F.round(F.round(value, 6), digits)
    return F.when(rounded.isNotNull(), F.format_string(f"%{sign}.{digits}f", rounded))


def render_report(fields: DataFrame) -> DataFrame:
    """A markdown report per anomaly from its fields: summary, impact, timeline, hypothesis and next steps by severity."""
    moment = F.date_format("detected_at", "yyyy-MM-dd HH:mm:ss")
    urgent = F.col("severity").isin("CRITICAL", "HIGH")
    slow = F.col("p99_latency") > 2 * F.col("avg_latency")
    body = F.concat_ws(
        "\n",
        F.concat(F.lit("# Incident "), "anomaly_id"),
        F.concat(F.lit("**Service**: `"), "service", F.lit("`, **severity**: "), "severity", F.lit(", **score**: "), _fixed("score", 3)),
        F.lit("\n## Summary"),
        F.concat(F.lit("Unusual behaviour of "), "service", F.lit(" was detected at "), moment, F.lit(".")),
        F.lit("\n## Impact"),
        F.concat(F.lit("- error rate: "), _fixed(F.col("error_rate") * 100, 2), F.lit("%")),
        F.concat(F.lit("- events per rollup bucket: "), F.col("total_events").cast("string"), F.lit(", error events seen: "), F.col("error_events").cast("string")),
        F.concat(F.lit("- latency: mean "), _fixed("avg_latency", 1), F.lit(" ms, p99 "), _fixed("p99_latency", 1), F.lit(" ms")),
        F.lit("\n## Likely cause"),
        F.when(F.col("error_rate") > 0.05, "Errors are raised above their usual share.").otherwise("No error surge; look at load and latency first."),
        F.when(slow, "The slowest requests take more than twice the mean."),
        F.lit("\n## Next steps"),
        F.when(urgent, "1. Page the owner of the service.\n2. Roll back the last change.").otherwise("1. Watch the next windows.\n2. Open a ticket."),
        F.lit("3. Compare with the recent anomalies of the service."),
    )
    return fields.withColumn("content", body)


def parse_responses(responses: DataFrame, text: str = "response") -> DataFrame:
    """Raw response text to a ``report`` struct; fences are stripped.

    A response that is not a complete report object gives a fallback record from the row's
    ``incident_id, service, detected_at, severity`` and the start of the raw text.
    """
    candidate = F.trim(F.regexp_replace(F.col(text), FENCE, ""))
    parsed = F.from_json(candidate, INCIDENT_REPORT)
    required = ("incident_id", "service", "detected_at", "severity", "confidence", "executive_summary", "root_cause_hypothesis")
    complete = parsed.isNotNull() & parsed["severity"].isin(*SEVERITIES)
    for name in required:
        complete = complete & parsed[name].isNotNull()
    level = F.upper(F.coalesce(F.col("severity"), F.lit("MEDIUM")))
    summary = F.substring(F.trim(F.coalesce(F.col(text), F.lit(""))), 1, FALLBACK_CHARS)
    none = lambda field: F.array().cast(INCIDENT_REPORT[field].dataType)
    fallback = F.struct(
        F.col("incident_id"),
        F.col("service"),
        F.col("detected_at"),
        F.when(level.isin(*SEVERITIES), level).otherwise("MEDIUM").alias("severity"),
        F.lit(FALLBACK_CONFIDENCE).alias("confidence"),
        F.when(summary == "", FALLBACK_EMPTY).otherwise(summary).alias("executive_summary"),
        F.lit(FALLBACK_CAUSE).alias("root_cause_hypothesis"),
        none("contributing_features").alias("contributing_features"),
        none("recommended_actions").alias("recommended_actions"),
        none("monitoring_checks").alias("monitoring_checks"),
    )
    ok = F.coalesce(complete, F.lit(False))
    return responses.withColumn("parsed_ok", ok).withColumn("report", F.when(ok, parsed).otherwise(fallback))


# Fixed text of a structured report: headings, line formats, rules, and the titles of the timeframes in order.
REPORT_TITLE = "# Incident Report: "
REPORT_HEAD = ("**Service**: `", "**Detected**: ", "**Severity**: ", "**Model confidence**: ")
REPORT_RULE = "---"
HEAD_SUMMARY, HEAD_CAUSE = "## Executive summary", "## Root cause hypothesis"
HEAD_FEATURES, HEAD_ACTIONS, HEAD_CHECKS = "## Top contributing features (SHAP)", "## Recommended actions", "## Monitoring follow-up"
FEATURE_TABLE = ("| Feature | Value | SHAP | Direction |", "|---|---|---|---|")
TIMEFRAMES = (("immediate", "### Immediate"), ("short_term", "### Short Term"), ("long_term", "### Long Term"))


def report_markdown(parsed: DataFrame, as_of: datetime, report: str = "report") -> DataFrame:
    """Markdown of a structured report: header, rules, attribution table, actions by timeframe, checks, footer."""
    r = F.col(report)

    def section(title: str, lines: Column, gap: str = "\n") -> Column:
        return F.when(F.size(lines) > 0, F.concat(F.lit(f"{title}\n\n"), F.array_join(lines, gap)))

    features = F.transform(
        r["contributing_features"],
        lambda f: F.concat(F.lit("| `"), f["name"], F.lit("` | "), _fixed(f["value"], 3), F.lit(" | "), _fixed(f["shap"], 3, "+"), F.lit(" | "), f["direction"], F.lit(" |")),
    )
    table = F.when(F.size(features) > 0, F.concat(F.array(*[F.lit(x) for x in FEATURE_TABLE]), features))

    def actions(timeframe: str, title: str) -> Column:
        wanted = F.filter(r["recommended_actions"], lambda a: a["timeframe"] == timeframe)
        return section(title, F.transform(wanted, lambda a: F.concat(F.lit("- **"), a["action"], F.lit("** — "), a["rationale"])))

    service, detected, severity, confidence = (F.lit(x) for x in REPORT_HEAD)
    head = F.concat_ws(
        "  \n",
        F.concat(service, r["service"], F.lit("`")), F.concat(detected, r["detected_at"]), F.concat(severity, r["severity"]),
        F.concat(confidence, _fixed(r["confidence"], 2)),
    )
    text = F.concat_ws(
        "\n\n",
        F.concat(F.lit(REPORT_TITLE), r["incident_id"]),
        head,
        F.lit(REPORT_RULE),
        F.concat(F.lit(f"{HEAD_SUMMARY}\n\n"), r["executive_summary"]),
        F.concat(F.lit(f"{HEAD_CAUSE}\n\n"), r["root_cause_hypothesis"]),
        section(HEAD_FEATURES, table),
        section(HEAD_ACTIONS, F.array_compact(F.array(*[actions(*t) for t in TIMEFRAMES])), "\n\n"),
        section(HEAD_CHECKS, F.transform(r["monitoring_checks"], lambda m: F.concat(F.lit("- "), m))),
        F.lit(REPORT_RULE),
        F.concat(F.lit("*Generated at "), F.date_format(F.lit(as_of), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("*")),
    )
    return parsed.withColumn("markdown", text)


#: The parts of an evidence text: what stands where a part has nothing to show.
NO_ATTRIBUTIONS, NO_METRICS, NO_EVENTS, NO_HISTORY = "none available", "No metrics available", "No events available", "none"


def _evidence(context: DataFrame) -> dict[str, Column]:
    """The parts of an evidence text, each a block of lines."""
    moment = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")
    top = F.transform(
        F.col("features.top_features"),
        lambda f: F.concat(
            F.lit("  - "), f["name"], F.lit(": value="), _fixed(f["value"], 3), F.lit(", shap="), _fixed(f["shap"], 3, "+"), F.lit(" ("), f["direction"], F.lit(")")
        ),
    )
    events = F.transform(
        F.slice(F.col("events"), 1, 10),
        lambda e, i: F.concat(
            (i + 1).cast("string"), F.lit(". ["), moment(e["time"]), F.lit("] "), e["level"], F.lit(" - "), e["service"], F.lit(": "), truncate(e["message"])
        ),
    )
    recent = F.transform(
        F.col("recent_anomalies"),
        lambda a: F.concat(a["rank"].cast("string"), F.lit(". ["), moment(a["time"]), F.lit("] "), a["severity"], F.lit(" score "), _fixed(a["score"], 3)),
    )

    def lines_or(rows: Column, default: str) -> Column:
        return F.when(F.size(rows) > 0, F.array_join(rows, "\n")).otherwise(default)

    names = ("avg_event_count", "avg_error_rate", "avg_latency", "avg_p95_latency", "avg_p99_latency")
    metrics = F.concat_ws("\n", *[F.concat(F.lit(f"- **{n.replace('_', ' ').title()}**: "), _fixed(n, 2)) for n in names])
    return {
        "head": F.concat(
            F.lit("Anomaly "), "anomaly_id", F.lit(" on "), "service", F.lit(" ("), "severity", F.lit("), score "), _fixed("score", 3),
            F.lit(", threshold "), _fixed("threshold", 3),
        ),
        "attributions": lines_or(top, NO_ATTRIBUTIONS),
        "metrics": F.when(F.col("avg_event_count").isNotNull(), metrics).otherwise(NO_METRICS),
        "events": lines_or(events, NO_EVENTS),
        "recent": lines_or(recent, NO_HISTORY),
    }


def evidence_prompt(context: DataFrame) -> DataFrame:
    """Free-text form: attributions, metric lines, the first ten context events, recent anomalies, and what to write."""
    part = _evidence(context)
    return context.select(
        "anomaly_id",
        F.concat_ws(
            "\n\n",
            part["head"],
            F.concat(F.lit("Attributions:\n"), part["attributions"]),
            F.concat(F.lit("Metrics:\n"), part["metrics"]),
            F.concat(F.lit("Events:\n"), part["events"]),
            F.concat(F.lit("Recent anomalies:\n"), part["recent"]),
            F.lit(
                "Write an incident report in markdown: what happened, who is affected, the likely cause with its evidence, "
                "what to do now and later, and what to watch."
            ),
        ).alias("prompt"),
    )


def structured_prompt(context: DataFrame) -> DataFrame:
    """Structured form: the same evidence with the window's feature values as JSON, and the fields of the answer.

    The fields are listed from the schema of a report, so a prompt always asks for what ``parse_responses`` reads.
    """
    part = _evidence(context)
    fields = ", ".join(f.name for f in INCIDENT_REPORT.fields)
    return context.select(
        "anomaly_id",
        F.concat_ws(
            "\n\n",
            F.lit("Answer with one JSON object and nothing else."),
            F.concat(F.lit("## Evidence\n"), part["head"]),
            F.concat(F.lit("## Contributing features\n"), part["attributions"]),
            F.concat(F.lit("## Feature values\n"), F.to_json(F.col("features.values"))),
            F.concat(F.lit("## Metrics\n"), part["metrics"]),
            F.concat(F.lit("## Events\n"), part["events"]),
            F.lit(f"## Fields\n{fields}\nSeverity is one of {', '.join(SEVERITIES)}; ground the hypothesis in the features listed."),
        ).alias("prompt"),
    )


def price_table(spark) -> DataFrame:
    """The fixed price list as a table (five rows)."""
    return spark.createDataFrame(MODEL_PRICES, "model string, input_per_m double, output_per_m double, is_default boolean")


def report_cost(usage: DataFrame, default_model: str = MODEL_PRICES[0][0]) -> DataFrame:
    """Add ``cost_usd`` (rounded to 6) and ``price_is_default`` from model, input_tokens and output_tokens."""
    prices = price_table(usage.sparkSession)
    fallback = {m: (i, o) for m, i, o, _ in MODEL_PRICES}[default_model]
    priced = usage.join(F.broadcast(prices.drop("is_default")), "model", "left")  # five fixed rows
    per_input = F.coalesce("input_per_m", F.lit(fallback[0])) / 1e6
    per_output = F.coalesce("output_per_m", F.lit(fallback[1])) / 1e6
    return (
        priced.withColumn("price_is_default", F.col("input_per_m").isNull())
        .withColumn("cost_usd", F.round(F.col("input_tokens") * per_input + F.col("output_tokens") * per_output, 6))
        .drop("input_per_m", "output_per_m")
    )
