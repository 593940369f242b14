"""Times operators on skewed events at growing sizes: a third of all events come from one service within one hour.

    python growth.py [EVENTS ...]        default 10000 100000 1000000; prints one JSON line a size

The tables are written to a new temporary folder; nothing is read from elsewhere.
"""

from __future__ import annotations

import json
import sys
import tempfile
import time
from collections.abc import Callable
from datetime import datetime
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

START, DAYS = datetime(2024, 1, 1), 30


def events(spark: SparkSession, n: int) -> DataFrame:
    """``n`` events of 30 days; every third is from ``hot`` and lies in one hour of day 10."""
    day = 86_400_000_000
    hot = F.col("id") % 3 == 0
    spread = F.pmod(F.xxhash64("id"), F.lit(DAYS * day))
    at = F.when(hot, F.lit(10 * day) + F.pmod(F.xxhash64("id"), F.lit(3_600_000_000))).otherwise(spread)
    level = F.when(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)) == 0, "ERROR").otherwise("INFO")
    latency = (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(5000)) / 10.0).cast("string")
    return spark.range(n).select(
        F.col("id").alias("event_id"),
        F.timestamp_micros(F.unix_micros(F.lit(START)) + at).alias("time"),
        F.when(hot, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 9)).alias("service"),
        level.alias("level"),
        F.concat(F.lit('{"latency_ms": '), latency, F.lit(', "endpoint": "/e'), F.col("id") % 7, F.lit('"}')).alias("metadata"),
    )


def operators(rows: DataFrame) -> dict[str, Callable[[], DataFrame]]:
    from vigilspark.functions.scalars import with_metadata_fields
    from vigilspark.operators import alerts, detection, features, rollups, windows

    typed = with_metadata_fields(rows)
    end = datetime(2024, 1, 1 + DAYS)
    errors = rows.where("level = 'ERROR'").select("service", "time", F.col("event_id").cast("string").alias("anomaly_id"))
    return {
        "rollup_1h": lambda: rollups.rollup(typed, "1 hour"),
        "window_features": lambda: features.window_features(windows.assign_windows(typed, START, end, 21_600, 10_800)),
        "event_checks_5m": lambda: windows.event_checks(rows, 300),
        "detections_1h": lambda: detection.detections(typed, 3_600, 1000, 10, 7_200, threshold=-0.16),
        "cooldown_2m": lambda: alerts.suppress_repeats(errors, 120),
    }


def main() -> None:
    from vigilspark.session import local_session

    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = local_session("growth", 8, spark__checkpoint__dir=f"{folder}/shared")
    sizes = [int(x) for x in sys.argv[1:]] or [10_000, 100_000, 1_000_000]
    for i, n in enumerate([sizes[0], *sizes]):  # the first size twice: the first run starts the session
        events(spark, n).write.parquet(f"{folder}/{i}")
        rows = spark.read.parquet(f"{folder}/{i}")
        seconds = {}
        for name, run in operators(rows).items():
            begin = time.perf_counter()
            run().write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - begin, 2)
        if i:
            print(json.dumps({"events": n, "seconds": seconds}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
