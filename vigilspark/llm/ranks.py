"""Seeded orders and running sums of any number of rows, with built-in functions only.

A row's place is its MD5 over a seed, its id and a hash of its text. The first digits of that digest cut the order into cells of like
size, however many rows one group holds; sums per cell are added up cell by cell, and rows are sorted inside one
cell of one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of the cell: 4096 cells for each group.
DIGITS = 3


def seeded(seed: int | Column, doc_id: Column, text_hash: Column) -> Column:
    """Place of a row in the order of ``seed``: 32 hex digits, from its id and a 64-bit hash of its text, so that rows
    of one id or none spread like others."""
    named = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.md5(F.concat_ws(":", F.lit(seed) if isinstance(seed, int) else seed, named, text_hash.cast("string")))


def running(df: DataFrame, keys: list[str], place: str, order: list[str], value: Column, name: str, digits: int = DIGITS) -> DataFrame:
    """Add ``name``, the sum of ``value`` up to and with each row, in the order (``place``, ``order``) of its group,
    and ``name_all``, that of the whole group. ``place`` is a column of hex digits; null keys are a group."""
    rows = df.withColumns({"_cell": F.substring(place, 1, digits), "_value": value})
    cells = rows.groupBy(*keys, "_cell").agg(F.sum("_value").alias("_in_cell"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_cell").alias("_k__cell"),
        F.coalesce(F.sum("_in_cell").over(before), F.lit(0)).alias("_before"),
        F.sum("_in_cell").over(group).alias(f"{name}_all"),
    )
    inside = Window.partitionBy(*keys, "_cell").orderBy(place, *order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_inside", F.sum("_value").over(inside))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in [*keys, "_cell"]]
    joined = rows.join(cells, on)
    return joined.select(*df.columns, (F.col("_before") + F.col("_inside")).alias(name), f"{name}_all")
