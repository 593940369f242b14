"""Structured Streaming jobs. Each one applies a batch operator, so its result equals the batch twin.

Grouped jobs first count equal cells per window in the state store (keys include the measured value, so a
busy service or window spreads over all state partitions); closed windows then go through the batch
operator with the counts as weights. Checks of a service keep its newest events in the state store (``stateful``);
the cooldown keeps a small versioned table next to its output. Every micro-batch writes to ``batch_id=N`` and
overwrites it when replayed, so a lost executor or a restart does not change the result.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilspark.functions.scalars import with_metadata_fields
from vigilspark.operators import alerts, attribution, detection, forest, validation, windows
from vigilspark.operators.features import window_features
from vigilspark.operators.rollups import rollup
from vigilspark.plans.cooldown import cooldown_kept
from vigilspark.schema import EVENT
from vigilspark.session import children, remove
from vigilspark.streaming import stateful

# Fixed values of the rollup refresh, in seconds behind the newest event: how long a bucket is still revised, and from
# when on it is there.
REFRESH = {"1 minute": (600, 60), "5 minutes": (1_200, 300), "1 hour": (10_800, 3_600)}
WIDTHS = {"1 minute": 60, "5 minutes": 300, "1 hour": 3_600}


def table_stream(spark: SparkSession, path: str, schema=EVENT, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of stored Parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def save_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def run(df: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start ``work`` on every micro-batch; the default trigger drains what is there and stops."""
    return (
        df.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(work)
        .start()
    )


def closed_cells(events: DataFrame, window: str, slide: str | None, late: str, columns: list[str]) -> DataFrame:
    """Equal rows of ``columns`` counted per window, emitted once the watermark has passed the window."""
    span = F.window("time", window, slide or window)
    return (
        events.withWatermark("time", late)
        .groupBy(span.alias("w"), *columns)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *columns, "n")
    )


def rollup_job(
    events: DataFrame, width: str, path: str, state_path: str, checkpoint: str, late_s: int | None = None, trigger: dict | None = None
) -> StreamingQuery:
    """Rollups refreshed as events come (batch twin: ``rollup`` of the buckets closed by then; read ``rollup_table``).

    A bucket is there once the newest event is the end offset past it, and is revised until the newest event is the
    start offset past it (``late_s`` if given). Cells of equal events are counted in update mode; each micro-batch
    stores the new counts of the cells it touched, the largest count of a cell is its latest. Output partitions (an
    hour of minutes, a day of hours) with a bucket that was touched or has just closed are computed anew from their
    cells and overwritten, so a replayed batch writes the same. Cells that no event can reach any more are removed.
    """
    start_s, end_s = REFRESH[width]
    start_s, width_s = late_s or start_s, WIDTHS[width]
    part = lambda c: F.date_format(c, "yyyy-MM-dd" if width_s >= 3_600 else "yyyy-MM-dd-HH")
    columns = ["service", "level", "latency_ms", "endpoint"]
    cells = (
        with_metadata_fields(events)
        .where("has_latency")
        .withWatermark("time", f"{start_s} seconds")
        .groupBy(F.window("time", width).alias("w"), *columns)
        .agg(F.count("*").alias("n"), F.max("time").alias("last"))
        .select(F.col("w.start").alias("bucket"), *columns, "n", "last")
        .withColumn("part", part(F.col("bucket")))
    )
    clock = Versions(f"{state_path}/clock")

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        replace = lambda df, to, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(to)
        replace(batch.withColumn("batch_id", F.lit(batch_id)), f"{state_path}/cells", "part", "batch_id")
        if not children(spark, f"{state_path}/cells"):  # nothing has come yet
            clock.write(spark.createDataFrame([(None,)], "newest timestamp"), batch_id)
            return
        stored = spark.read.schema(batch.withColumn("batch_id", F.lit(0)).schema).parquet(f"{state_path}/cells")
        mine = stored.where(F.col("batch_id") == batch_id).agg(F.max("last").alias("newest"), F.min("part").alias("part")).first()
        before = clock.read(spark, batch_id)
        before = before.first() if before is not None else None
        newest = max([x for x in (mine["newest"], before["newest"] if before else None) if x is not None], default=None)
        clock.write(spark.createDataFrame([(newest,)], "newest timestamp"), batch_id)
        if newest is None:
            return
        since = (before["newest"] if before and before["newest"] else newest) - timedelta(seconds=end_s + width_s)
        low = F.least(part(F.lit(since)), F.lit(mine["part"]) if mine["part"] else part(F.lit(since)))
        closed = F.col("bucket") + F.expr(f"INTERVAL {width_s + end_s} SECONDS") <= F.lit(newest)
        rows = stored.where((F.col("part") >= low) & closed).groupBy("part", "bucket", *columns).agg(F.max("n").alias("n"))
        rows = rows.withColumn("time", F.col("bucket")).withColumn("has_latency", F.lit(True)).drop("part", "bucket")
        replace(rollup(rows, width, weight="n").withColumn("part", part(F.col("bucket"))), path, "part")
        if before and before["newest"]:
            old = before["newest"] - timedelta(seconds=start_s + end_s + 2 * width_s + 86_400)
            name = f"part={old:%Y-%m-%d}" if width_s >= 3_600 else f"part={old:%Y-%m-%d-%H}"
            for folder in children(spark, f"{state_path}/cells"):
                if folder.startswith("part=") and folder < name:
                    remove(spark, f"{state_path}/cells/{folder}")

    writer = cells.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    return writer.foreachBatch(work).start()


def rollup_table(spark: SparkSession, path: str) -> DataFrame:
    """The buckets that ``rollup_job`` has written."""
    return spark.read.parquet(path).drop("part")


def feature_job(
    events: DataFrame,
    size_s: int,
    stride_s: int,
    path: str,
    checkpoint: str,
    late: str = "10 minutes",
    min_events: int = 10,
    trigger: dict | None = None,
    then: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Feature rows of closed windows (batch twin: ``window_features``); ``then`` may use them further."""
    cells = closed_cells(
        with_metadata_fields(events), f"{size_s} seconds", f"{stride_s} seconds", late, ["service", "level", "valid_latency"]
    )

    def work(batch: DataFrame, batch_id: int) -> None:
        save_batch(window_features(batch, min_events=min_events, weight="n"), path, batch_id)
        if then is not None:
            then(batch.sparkSession.read.parquet(f"{path}/batch_id={batch_id}"), batch_id)

    return run(cells, work, checkpoint, trigger)


def detection_sink(
    checks_path: str, anomalies_path: str, alerts_path: str, model: forest.Forest | None = None, explain: bool = True
) -> Callable[[DataFrame, int], None]:
    """Saves every scored check; kept ones go to the anomaly table and the alert messages, explained by the model."""

    def work(batch: DataFrame, batch_id: int) -> None:
        from vigilspark.sources.writers import alert_messages

        save_batch(detection.typed(batch), checks_path, batch_id)
        kept = batch.sparkSession.read.parquet(f"{checks_path}/batch_id={batch_id}").where("kept")
        rows = kept.withColumn("detected_at", F.col("tick"))
        if model is not None and explain:
            judged = forest.score(rows.drop("score", "threshold", "is_anomaly"), model).drop("score", "threshold")
            known = rows.select("service", "tick", "score", "threshold")
            rows = attribution.attribute(judged.withColumn("is_anomaly", F.lit(True)), model).join(known, ["service", "tick"])
        records = alerts.alert_records(rows).persist()
        save_batch(alerts.anomaly_rows(records), anomalies_path, batch_id)
        alert_messages(records).write.mode("overwrite").json(f"{alerts_path}/batch_id={batch_id}")
        records.unpersist()

    return work


def detection_job(
    events: DataFrame,
    judge: detection.RuleJudge,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    interval_s: int,
    size: int = 1000,
    cooldown_s: int = 120,
    tiebreak: str = "event_id",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Detection per service over its trailing buffer with cooldown (twin: ``detection.detections``).

    ``events`` have time, service, the tie-break, level and valid_latency. Start it in a ``stateful_session``.
    """
    answers = stateful.checks(
        events, ["level", "valid_latency"], tiebreak, detection.DETECTION,
        lambda schema: stateful.ServiceChecks(schema, tiebreak, interval_s, size, judge, cooldown_s),
    )
    return run(answers, sink, checkpoint, trigger)


def ingest_job(
    raw: DataFrame, events_path: str, quarantine_path: str, checkpoint: str, host: str, trigger: dict | None = None
) -> StreamingQuery:
    """Validate raw JSON lines: accepted events and rejected lines are written apart (twin: ``parse_json_events``)."""

    def work(batch: DataFrame, batch_id: int) -> None:
        parsed = validation.parse_json_events(batch).persist()
        good = validation.enrich(validation.accepted(parsed).drop("raw"), F.current_timestamp(), F.lit(host))
        save_batch(good, events_path, batch_id)
        save_batch(validation.quarantined(parsed), quarantine_path, batch_id)
        parsed.unpersist()

    return run(raw, work, checkpoint, trigger)


def deduplicated(events: DataFrame, late: str = "10 minutes", keys: tuple[str, ...] = ("trace_id", "span_id")) -> DataFrame:
    """Drops redelivered events seen within the watermark; without all of its keys an event is known by its content."""
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    content = F.sha2(F.to_json(F.struct(*[F.col(c) for c in events.columns])), 256)
    name = F.when(known, F.to_json(F.struct(*keys))).otherwise(content)
    return events.withColumn("_name", name).withWatermark("time", late).dropDuplicatesWithinWatermark(["_name"]).drop("_name")


class Versions:
    """A table rewritten by every micro-batch: batch N reads version N-1 and writes version N; two versions are kept.

    A missing earlier version is an error, never an empty state.
    """

    def __init__(self, path: str) -> None:
        self.path = path

    def read(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        return spark.read.parquet(f"{self.path}/v={batch_id - 1}") if batch_id else None

    def write(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={batch_id}")
        remove(df.sparkSession, f"{self.path}/v={batch_id - 2}")


def cooldown_job(
    alert_rows: DataFrame,
    path: str,
    state_path: str,
    checkpoint: str,
    cooldown_seconds: int = 120,
    time: str = "time",
    tiebreak: str = "anomaly_id",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Alert cooldown across micro-batches in time order (twin: ``cooldown_kept``). State: one row per service."""
    state = Versions(state_path)

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        entry = state.read(spark, batch_id)
        save_batch(cooldown_kept(batch, ["service"], time, tiebreak, cooldown_seconds, entry), path, batch_id)
        kept = spark.read.parquet(f"{path}/batch_id={batch_id}")
        blocked = (F.unix_micros(F.max(time)) + cooldown_seconds * 1_000_000).alias("blocked_until")
        latest = kept.groupBy("service").agg(blocked)
        if entry is not None:
            latest = latest.unionByName(entry).groupBy("service").agg(F.max("blocked_until").alias("blocked_until"))
        state.write(latest, batch_id)

    return run(alert_rows, work, checkpoint, trigger)


def trailing_buffer_job(
    events: DataFrame,
    path: str,
    checkpoint: str,
    interval_s: int,
    size: int = 1000,
    tiebreak: str = "event_id",
    trigger: dict | None = None,
) -> StreamingQuery:
    """The newest ``size`` events per service at every check (twin: ``trailing_buffer`` over ``event_checks``)."""
    columns = [c for c in events.columns if c not in ("service", "time")]
    kinds = dict(events.dtypes)
    output = "service string, tick_us long, age long, at_us long, " + ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    answers = stateful.checks(
        events, columns, tiebreak, output,
        lambda schema: stateful.ServiceChecks(schema, tiebreak, interval_s, size, stateful.buffer_rows(["at_us", *columns])),
    )
    rows = answers.select(
        "service", F.timestamp_micros("tick_us").alias("tick"), F.timestamp_micros("at_us").alias("time"), "age", *columns
    )
    return run(rows, lambda batch, i: save_batch(batch, path, i), checkpoint, trigger)


def context_job(
    alert_rows: DataFrame, stored_events: Callable[[], DataFrame], path: str, checkpoint: str, minutes: int = 10,
    limit: int = 100, tiebreak: str = "event_id", trigger: dict | None = None,
) -> StreamingQuery:
    """Context events of every new alert from the stored event table (twin: ``context_events``)."""

    def work(batch: DataFrame, batch_id: int) -> None:
        save_batch(windows.context_events(batch, stored_events(), minutes, limit, tiebreak), path, batch_id)

    return run(alert_rows, work, checkpoint, trigger)
