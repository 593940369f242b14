"""Sinks: stored tables partitioned by date, alert and report outputs, exports, retention and compaction."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilspark.session import children, discard, materialize, remove


def with_event_date(df: DataFrame, time: str = "time") -> DataFrame:
    return df.withColumn("event_date", F.to_date(time))


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Append to the event table. Range partitioning splits a busy day or service over many files, each
    sorted by (service, time) so that row groups can be skipped."""
    order = ["event_date", "service", "time"]
    dated = with_event_date(events)
    dated.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("event_date").parquet(path)


def write_anomalies(anomalies: DataFrame, path: str, mode: str = "append") -> None:
    with_event_date(anomalies).write.mode(mode).partitionBy("event_date").parquet(path)


def alert_messages(alerts: DataFrame) -> DataFrame:
    """(key, value) messages: key is the service, value the alert as JSON."""
    return alerts.select(F.col("service").alias("key"), F.to_json(F.struct(*alerts.columns)).alias("value"))


def write_reports(reports: DataFrame, path: str, mode: str = "append") -> None:
    """Append to the report table, partitioned by the date of generation."""
    with_event_date(reports, "generated_at").write.mode(mode).partitionBy("event_date").parquet(path)


def upsert_reports(new: DataFrame, path: str, key: str = "report_id", time: str = "generated_at") -> None:
    """Write ``new`` into the report table: rows with a known ``key`` replace those stored, others are added.

    Only date partitions that hold a replaced row or get a new one are rewritten (computed aside, then swapped by
    dynamic overwrite); files of other dates stay as they are. Where they lie is found from the key column alone. Of
    new rows with one key the latest by ``time`` counts. Columns that only one side has are null in the other's rows.
    """
    spark = new.sparkSession
    latest = Window.partitionBy(key).orderBy(F.desc(time), F.xxhash64(*[c for c in new.columns if dict(new.dtypes)[c][:3] != "map"]))
    fresh = materialize(with_event_date(new, time).withColumn("_r", F.row_number().over(latest)).where("_r = 1").drop("_r"))
    if not any(name.startswith("event_date=") for name in children(spark, path)):  # no table, or one without rows
        fresh.write.mode("append").partitionBy("event_date").parquet(path)
        return discard(fresh)
    stored = spark.read.option("mergeSchema", True).parquet(path)
    replaced = stored.select(key, "event_date").join(fresh.select(key), key, "left_semi").select("event_date")
    dates = materialize(replaced.union(fresh.select("event_date")).distinct())
    touched = [r[0] for r in dates.collect()]  # one row per day
    kept = stored.where(F.col("event_date").isin(touched)).join(fresh.select(key), key, "left_anti")
    rows = materialize(kept.unionByName(fresh, allowMissingColumns=True))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path)
    full = {r[0] for r in rows.select("event_date").distinct().collect()}
    for day in touched:
        if day not in full:  # its rows have moved to other dates
            remove(spark, f"{path}/event_date={day}")
    discard(fresh, dates, rows)


def dated_documents(reports: DataFrame) -> DataFrame:
    """(report_id, content, y, m, d, filepath) of the dated document tree."""
    day = F.col("generated_at")
    return reports.select(
        "report_id",
        "content",
        F.date_format(day, "yyyy").alias("y"),
        F.date_format(day, "MM").alias("m"),
        F.date_format(day, "dd").alias("d"),
        F.concat(F.date_format(day, "yyyy/MM/dd/"), "report_id", F.lit(".md")).alias("filepath"),
    )


def write_documents(reports: DataFrame, path: str, mode: str = "append") -> None:
    dated_documents(reports).write.mode(mode).partitionBy("y", "m", "d").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header; used for the feature matrix and the windowed metrics export."""
    df.write.mode(mode).option("header", True).csv(path)


def retention_split(rows: DataFrame, as_of: datetime, days: int, time: str = "time") -> DataFrame:
    """Per date: how many rows a retention of ``days`` keeps and drops."""
    old = F.col(time) < F.lit(as_of - timedelta(days=days))
    return rows.groupBy(F.to_date(time).alias("event_date")).agg(
        F.count_if(~old).alias("kept"), F.count_if(old).alias("dropped")
    )


def drop_old_partitions(spark: SparkSession, table: str, as_of: datetime, days: int) -> list[date]:
    """Drop whole date partitions that lie before the retention bound of a catalog table; no data is read."""
    bound = (as_of - timedelta(days=days)).date()
    names = [r[0].split("=", 1)[1] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()]  # one row per day
    old = sorted(d for d in map(date.fromisoformat, names) if d < bound)
    if old:
        parts = ", ".join(f"PARTITION (event_date = DATE'{d}')" for d in old)
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {parts}")
    return old


def compacted(rows: DataFrame, as_of: datetime, days: int, segment: tuple[str, ...] = ("service", "level")) -> DataFrame:
    """Rows older than ``days`` laid out for cold storage: by date and segment, newest first, balanced by range."""
    old = with_event_date(rows).where(F.col("event_date") < F.lit((as_of - timedelta(days=days)).date()))
    order = [F.col("event_date"), *[F.col(c) for c in segment], F.desc("time")]
    return old.repartitionByRange(*order).sortWithinPartitions(*order)


def write_compacted(rows: DataFrame, path: str, as_of: datetime, days: int, segment: tuple[str, ...] = ("service", "level")) -> None:
    (
        compacted(rows, as_of, days, segment)
        .write.mode("overwrite")
        .option("compression", "zstd")
        .partitionBy("event_date")
        .parquet(path)
    )
