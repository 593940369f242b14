"""Record and batch validation, quarantine, enrichment and ingest outcome counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilspark.functions.scalars import iso_timestamp, with_metadata_fields
from vigilspark.schema import LEVELS, WIRE_EVENT

_CORRUPT = "_corrupt_record"


def record_errors(event: Column | None = None) -> Column:
    """Array of rule names a record breaks; empty means valid. ``event`` is a struct, or None for top columns."""

    def field(name: str) -> Column:
        return F.col(name) if event is None else event.getField(name)

    def missing(name: str) -> Column:
        return F.coalesce(field(name), F.lit("")) == ""

    rules = [
        ("timestamp_required", field("time").isNull()),
        ("service_required", missing("service")),
        ("service_too_long", F.length(field("service")) > 255),
        ("level_required", missing("level")),
        ("level_invalid", ~missing("level") & ~field("level").isin(*LEVELS)),
        ("message_required", missing("message")),
    ]
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]))


def parse_json_events(raw: DataFrame, text: str = "raw") -> DataFrame:
    """JSON text to event columns plus ``status``: accepted, validation_error or unmarshal_error.

    Broken JSON and unreadable timestamps are unmarshal errors; the text stays in the row.
    """
    schema = T.StructType([*WIRE_EVENT.fields, T.StructField(_CORRUPT, T.StringType())])
    parsed = raw.withColumn(
        "_e", F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    )
    others = [c for c in raw.columns if c != text]
    events = parsed.select(
        *others,
        text,
        iso_timestamp(F.col("_e.timestamp")).alias("time"),
        *[F.col(f"_e.{f.name}").alias(f.name) for f in WIRE_EVENT.fields if f.name != "timestamp"],
        (
            F.col("_e").isNull()
            | F.col(f"_e.{_CORRUPT}").isNotNull()
            | (F.col("_e.timestamp").isNotNull() & iso_timestamp(F.col("_e.timestamp")).isNull())
        ).alias("_broken"),
    )
    return (
        events.withColumn("errors", F.when(F.col("_broken"), F.array(F.lit("unmarshal_error"))).otherwise(record_errors()))
        .withColumn(
            "status",
            F.when(F.col("_broken"), "unmarshal_error")
            .when(F.size("errors") > 0, "validation_error")
            .otherwise("accepted"),
        )
        .drop("_broken")
    )


def validate_events(events: DataFrame) -> DataFrame:
    """Add ``errors`` and ``status`` to already typed events."""
    return events.withColumn("errors", record_errors()).withColumn(
        "status", F.when(F.size("errors") > 0, "validation_error").otherwise("accepted")
    )


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("status") == "accepted").drop("errors", "status")


def quarantined(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("status") != "accepted")


def validate_batches(batches: DataFrame, events: str = "events", max_events: int = 1000) -> DataFrame:
    """All-or-nothing batches: 1 to ``max_events`` elements, every one valid."""
    size = F.coalesce(F.size(events), F.lit(0))
    bad = F.coalesce(F.size(F.filter(events, lambda e: F.size(record_errors(e)) > 0)), F.lit(0))
    return (
        batches.withColumn("n_events", size)
        .withColumn("n_invalid", bad)
        .withColumn("batch_accepted", size.between(1, max_events) & (bad == 0))
    )


def batch_events(validated: DataFrame, events: str = "events") -> DataFrame:
    """The single events of accepted batches."""
    rest = [c for c in validated.columns if c not in (events, "n_events", "n_invalid", "batch_accepted")]
    return validated.where("batch_accepted").select(*rest, F.inline(events))


def event_name(columns: Sequence[str]) -> Column:
    """A deterministic id of an event: a hash of what was sent, so a redelivered event has the same id.

    Drop redelivered events (``streaming.jobs.deduplicated``) before the id serves as a tie-break.
    """
    sent = [c for c in ("time", "service", "level", "message", "metadata", "trace_id", "span_id") if c in columns]
    return F.xxhash64(*sent)


def enrich(events: DataFrame, batch_time: Column, host: Column) -> DataFrame:
    """Default the event time, stamp ingestion time and host; one ``batch_time`` keeps reruns identical.

    Events without an ``event_id`` of their own get one from their content, and the fields that operators read from
    ``metadata`` become columns, so that the JSON is parsed once, here.
    """
    if "event_id" not in events.columns:  # before the time is set, which a replayed batch sets anew
        events = events.withColumn("event_id", event_name(events.columns))
    out = (
        events.withColumn("time", F.coalesce("time", batch_time))
        .withColumn("ingested_at", batch_time)
        .withColumn("host", host)
    )
    return with_metadata_fields(out) if "metadata" in out.columns else out


def outcome_counts(validated: DataFrame) -> DataFrame:
    """Counts per service, level and status; records that did not parse have no service and level."""
    return validated.groupBy("service", "level", "status").agg(F.count("*").alias("n"))
