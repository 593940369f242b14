"""Keep a row only if enough time passed since the last *kept* row of its key (see ``chains``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.plans.chains import chained


def cooldown_kept(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    tiebreak: str,
    cooldown_seconds: int | Column,
    entry: DataFrame | None = None,
) -> DataFrame:
    """The rows of ``df`` that survive the cooldown; of rows at one instant the lowest ``tiebreak``.

    ``cooldown_seconds`` may be a column that is the same for all rows of a key. ``entry`` (keys, ``blocked_until``
    micros) carries the state of an earlier batch. Rows with a null key are left out.
    """
    keys = list(keys)
    seconds = F.lit(cooldown_seconds) if isinstance(cooldown_seconds, int) else cooldown_seconds
    rows = df.withColumns({"_us": F.unix_micros(time), "_wait": seconds.cast("bigint") * 1_000_000})
    moments = rows.groupBy(*keys, "_us").agg(F.min(tiebreak).alias(tiebreak), F.min("_wait").alias("_wait"))
    if entry is not None:  # rows inside the carried cooldown can never be kept
        moments = (
            moments.join(entry, keys, "left")
            .where(F.col("blocked_until").isNull() | (F.col("_us") >= F.col("blocked_until")))
            .drop("blocked_until")
        )
    kept = moments.drop("_wait").join(chained(moments, keys, "_us", F.col("_wait")), [*keys, "_us"], "left_semi")
    return rows.drop("_wait").join(kept, [*keys, "_us", tiebreak], "left_semi").select(*df.columns)
