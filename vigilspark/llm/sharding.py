"""Proportional stratified interleaving into shards, with DataFrame functions only.

Rows are shuffled by seed inside their source and ranked; rank r of a source of n rows stands at the fraction
(2r - 1) / 2n. Sorting all rows by that fraction interleaves the sources in proportion everywhere, so cutting the
order into equal counts gives every shard the mixture of the whole: shards differ by one row at most, and a source
of n rows has between floor(n / shards) - 1 and ceil(n / shards) + 1 rows in each.

Both orders are cut into cells (``ranks``, and cells of the fraction), so neither a source that holds a third of
the rows nor the global order ever sits in one task.

A null source is a source; a null text has no bytes. Rows that agree in id, text and source are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.llm import ranks

#: Cells of the global order, a fixed number: the only table ordered in one task.
CELLS = 16_000


def interleave(docs: DataFrame, shards: int = 16, seed: int = 7, source: str = "source", doc_id: str = "doc_id", text: str = "text", cells: int = CELLS) -> DataFrame:
    """One row per document: doc_id, source, size (bytes and 1), text_crc32, shard, slot (place in the shard)."""
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
        ranks.seeded(seed, F.col(doc_id), F.xxhash64(text)).alias("place"),
    )
    ranked = ranks.running(rows, ["source"], "place", ["doc_id", "text_crc32", "size"], F.lit(1).cast("long"), "rank")
    at = ranked.withColumn("at", (2 * F.col("rank") - 1) / (2 * F.col("rank_all")))
    at = at.withColumn("cell", F.floor(F.col("at") * cells))

    counts = at.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(0))
    before = everything.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(everything).alias("total"))
    inside = Window.partitionBy("cell").orderBy("at", "source", "place", "doc_id", "text_crc32", "size")
    placed = at.withColumn("inside", F.row_number().over(inside)).join(counts, "cell")
    place = F.col("before") + F.col("inside") - 1
    placed = placed.withColumn("g", place).withColumn("shard", F.expr(f"g * {shards} div total").cast("int"))
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return placed.select("doc_id", "source", "size", "text_crc32", "shard", (F.col("g") - first).alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: ``documents`` in 16 shards whose counts differ by one at most."""
    out = interleave(spark.read.parquet(f"{sf_dir}/documents.parquet"), 16)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


#: DuckDB has no CRC-32; each byte goes through eight shifts, which is too slow on whole texts. So there is no SQL
#: for op6, and the tests compare with brute force.
SQL = None
