"""Readers for event logs, stored tables, timelines, feature matrices and labelled series."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilspark.functions.scalars import iso_timestamp
from vigilspark.plans.ordering import global_rank, time_cells
from vigilspark.schema import FEATURE_NAMES, TIMELINE, WIRE_EVENT

_LOG_SCHEMA = T.StructType([T.StructField("time", T.StringType()), *[f for f in WIRE_EVENT.fields]])


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """JSON event files as a stream of raw text lines (column ``raw``)."""
    return (
        spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(path).withColumnRenamed("value", "raw")
    )


def event_topic(spark: SparkSession, servers: str, topic: str = "events", per_trigger: int | None = None) -> DataFrame:
    """A Kafka topic as raw text lines from the latest offset; needs the Kafka connector on the class path."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "latest")
    )
    if per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", per_trigger)
    return reader.load().select(F.col("value").cast("string").alias("raw"), "timestamp")


def in_time_range(time: str, start: datetime, end: datetime, date: str | None = None) -> Column:
    """``start <= time < end``; with ``date`` also the bounds on the partition column, which prune files."""
    keep = (F.col(time) >= F.lit(start)) & (F.col(time) < F.lit(end))
    if date:
        keep = keep & F.col(date).between(F.lit(start.date()), F.lit((end - timedelta(microseconds=1)).date()))
    return keep


def _log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines of a log: raw, the fields, and whether the line and its time can be read."""
    schema = T.StructType([*_LOG_SCHEMA.fields, T.StructField("_corrupt", T.StringType())])
    event = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("raw"), event.alias("e")).select("raw", "e.*")
    rows = rows.withColumn("time", iso_timestamp(F.coalesce("time", "timestamp"))).drop("timestamp")
    return rows.withColumn("readable", F.col("_corrupt").isNull()).drop("_corrupt")


def read_event_log(spark: SparkSession, path: str, start: datetime, end: datetime) -> DataFrame:
    """JSON-lines events of ``[start, end)``; the stamp is ``time`` or ``timestamp``, naive stamps are UTC.

    Blank lines give no row; what can't be read is in ``unread_event_log``.
    """
    return _log_lines(spark, path).where(F.col("readable") & in_time_range("time", start, end)).drop("raw", "readable")


def unread_event_log(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a log that ``read_event_log`` can place in no range: raw, reason."""
    rows = _log_lines(spark, path)
    reason = F.when(~F.col("readable"), "unreadable line").otherwise("unreadable time")
    return rows.where(~F.col("readable") | F.col("time").isNull()).select("raw", reason.alias("reason"))


def scan_events(spark: SparkSession, path: str, start: datetime, end: datetime) -> DataFrame:
    """Stored events of ``[start, end)``; partition and row-group pruning by date and time."""
    return spark.read.parquet(path).where(in_time_range("time", start, end, "event_date"))


def timeline_scenarios(documents: DataFrame, text: str = "document") -> DataFrame:
    """Timeline documents (JSON text with a nested scenario list) to scenario rows in file order."""
    parsed = documents.withColumn("_t", F.from_json(text, TIMELINE))
    others = [c for c in documents.columns if c != text]
    return parsed.select(*others, F.posexplode("_t.scenarios").alias("scenario_no", "_s")).select(
        *others,
        "scenario_no",
        F.col("_s.type").alias("type"),
        iso_timestamp(F.col("_s.start_utc")).alias("start_ts"),
        iso_timestamp(F.col("_s.end_utc")).alias("end_ts"),
    )


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """One scenario timeline file; ``scenario_id`` is the position in the file."""
    text = spark.read.text(path, wholetext=True).withColumnRenamed("value", "document")
    return timeline_scenarios(text).withColumnRenamed("scenario_no", "scenario_id")


def read_feature_csv(spark: SparkSession, path: str) -> DataFrame:
    """Known feature columns of a CSV feature matrix, in contract order. All files must have the header of the first."""
    header = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    known = [n for n in FEATURE_NAMES if n in header.columns]
    if not known:
        raise ValueError(f"{path} holds none of the feature columns, such as {', '.join(FEATURE_NAMES[:3])}")
    return header.select(*[F.col(f"`{n}`").cast("double").alias(n) for n in known])


def _file_stream() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^./]+$", 1)


def read_series_csv(spark: SparkSession, paths: str | list[str], stream: Column | None = None) -> DataFrame:
    """CSV files (timestamp, value); the stream is the file name unless ``stream`` says otherwise, ``i`` the time order."""
    rows = (
        spark.read.schema("timestamp string, value double")
        .option("header", True)
        .csv(paths)
        .select(
            (_file_stream() if stream is None else stream).alias("stream"),
            iso_timestamp(F.col("timestamp")).alias("ts"),
            "value",
        )
    )
    ranked = global_rank(rows, time_cells(F.col("ts"), 86_400), [F.col("ts"), F.col("value")], "i", ["stream"])
    return ranked.withColumn("i", F.col("i") - 1).withColumn("metric", F.lit(0))


def read_label_spans(spark: SparkSession, path: str) -> DataFrame:
    """JSON map of stream file to [start, end] pairs, as (stream, span_start, span_end)."""
    text = spark.read.text(path, wholetext=True)
    spans = text.select(F.explode(F.from_json("value", "map<string, array<array<string>>>")).alias("file", "spans"))
    return spans.select("file", F.explode("spans").alias("s")).select(
        F.regexp_extract("file", r"([^/]+?)(\.[^./]+)?$", 1).alias("stream"),
        iso_timestamp(F.col("s")[0]).alias("span_start"),
        iso_timestamp(F.col("s")[1]).alias("span_end"),
    )


def read_numbered_lines(spark: SparkSession, paths: str | list[str], stream: Column | None = None) -> DataFrame:
    """(stream, i, line): text lines with their 0-based position in the file. A stream is one file: it has the file's
    name unless ``stream`` says otherwise.

    Lines are ordered inside a file split; splits are ordered by their start byte, so large files stay split.
    """
    lines = spark.read.text(paths).select(
        (_file_stream() if stream is None else stream).alias("stream"),
        F.col("value").alias("line"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    ranked = global_rank(lines, F.col("block"), [F.col("at")], "i", ["stream"])
    return ranked.select("stream", (F.col("i") - 1).alias("i"), "line").where(F.trim("line") != "")


def read_matrix_series(
    spark: SparkSession, data: str | list[str], labels: str | list[str], start: datetime, stream: Column | None = None
) -> DataFrame:
    """Headerless metric matrices with label vectors: long rows, cut to the shorter, one minute per line."""
    values = read_numbered_lines(spark, data, stream).select(
        "stream", "i", F.posexplode(F.split("line", ",")).alias("metric", "text")
    )
    marks = read_numbered_lines(spark, labels, stream).select("stream", "i", F.col("line").cast("double").cast("int").alias("label"))
    return values.join(marks, ["stream", "i"]).select(
        "stream",
        "i",
        F.timestamp_micros(F.unix_micros(F.lit(start)) + F.col("i") * 60_000_000).alias("ts"),
        "metric",
        F.trim("text").try_cast("double").alias("value"),
        "label",
    )

