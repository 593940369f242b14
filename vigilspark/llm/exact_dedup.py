"""Exact dedup by deterministic block naming, with DataFrame functions only.

A text is cut into blocks of ``block`` characters. Sorting the distinct blocks (by a hash, then by content) gives every
block an integer name, equal for equal blocks alone. Adjacent names are then paired, the pairs are sorted and named in turn, and
so on until a document has one name: its collision-free identity. Documents with as many blocks and the same
name are equal.

Only what occurs more than once needs a name. A block whose 64-bit hash no other block has is unlike every other
block, so its document is a copy of none and is done; the same holds for a pair that occurs once. What is left is
compared and sorted by content, never by hash.

Copies meet only as counted rows: the distinct blocks and pairs are written before they are joined back, so both
sides of each join are plain shuffles whose hot keys Spark splits.

Nulls count as empty texts. Rows are told apart by id and text (a 64-bit hash of the original text beside the digest of
the normalised one); repeated rows are copies of each other of which one stays. A null id sorts after all others. Of
equal texts with one id and length the original with the smallest hash stays. Other columns pass through ``keep_first``
unchanged, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.session import materialize

WHITE = r"[\x20\x09-\x0D]"
BLOCK = 4096


def normalised(text: Column) -> Column:
    """The text without white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def _names(parts: DataFrame, columns: list[str]) -> DataFrame:
    """Integer names of the distinct rows of ``columns`` that occur more than once, in the order of a 64-bit hash and
    then of their content. Ranges are cut by the hash alone, so the driver samples numbers and no blocks."""
    many = parts.groupBy(*columns).agg(F.count(F.lit(1)).alias("_times")).filter("_times > 1")
    many = many.select(*columns, F.xxhash64(*columns).alias("_hash")).repartitionByRange("_hash").sortWithinPartitions("_hash", *columns)
    return materialize(many.select(*columns, F.monotonically_increasing_id().alias("name")))


def _whole(parts: DataFrame, n: Column) -> DataFrame:
    """Documents of which every part has a name, as one row per part."""
    seen = parts.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("want"))
    return parts.join(seen.filter(F.col("m") == n).select("key"), "key", "left_semi")


def identities(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``docs``: key, text. Returns key, blocks, name for every document that equals another one."""
    norm = docs.select("key", normalised(F.col("text")).alias("t"))
    norm = norm.withColumn("n", F.greatest(F.lit(1), F.ceil(F.length("t") / block)).cast("int"))
    at = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")
    parts = norm.select("key", "n", "t", at).select("key", "n", "i", F.substring("t", F.col("i") * block + 1, F.lit(block)).alias("part"))
    parts = parts.withColumn("h", F.xxhash64("part", "i", "n"))

    often = materialize(parts.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h"))
    parts = materialize(parts.join(often, "h", "left_semi").select("key", "n", "i", "part"))
    named = parts.join(_names(parts, ["part"]), "part").select("key", "n", "i", "name").distinct()  # repeated rows
    longest = parts.agg(F.max("n")).first()[0] or 1
    named = materialize(_whole(named, F.col("want")))

    for level in range(math.ceil(math.log2(longest))):
        size = 1 << level  # blocks that one name stands for
        pairs = named.filter(F.col("n") > size).groupBy("key", "n", F.shiftright("i", 1).alias("i")).agg(
            F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
        )
        done = named.filter(F.col("n") <= size)
        pairs = materialize(pairs)
        merged = pairs.join(_names(pairs, ["n", "left", "right"]), ["n", "left", "right"])
        merged = _whole(merged.select("key", "n", "i", "name"), F.ceil(F.col("want") / (2 * size)))
        named = materialize(done.unionByName(merged))
    return named.select("key", F.col("n").alias("blocks"), "name")


def duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_chars (code points), text_sha256, keep_id, group_size, kept.

    Of equal texts the longest original stays, then the smallest id.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *_form(F.col(text)))
    form = ["doc_id", "n_chars", "text_sha256", "raw"]
    slim = materialize(rows.groupBy(*form).agg(F.count(F.lit(1)).alias("copies")))
    same = identities(rows.select(F.struct(*form).alias("key"), F.coalesce("text", F.lit("")).alias("text")), block).distinct()

    mine = slim.withColumn("key", F.struct(*form)).join(same, "key", "left")
    alone = mine.filter(F.col("name").isNull())
    shared = materialize(mine.filter(F.col("name").isNotNull()).drop("key"))
    first = F.min(F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), "doc_id", "raw")).alias("first")
    groups = materialize(
        shared.groupBy("blocks", "name").agg(first, F.sum("copies").alias("group_size"))
    )
    best = (F.col("n_chars") == -F.col("first.col1")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("raw") == F.col("first.raw"))
    shared = shared.join(groups, ["blocks", "name"]).withColumns({"keep_id": F.col("first.doc_id"), "best": best})
    columns = [*form, "copies", "keep_id", "group_size", "best"]
    alone = alone.select(*form, "copies", F.col("doc_id").alias("keep_id"), F.col("copies").alias("group_size"), F.lit(True).alias("best"))
    out = shared.select(*columns).unionByName(alone)
    out = out.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return out.select(
        "doc_id", "n_chars", "text_sha256", "raw", "copies", "keep_id", "group_size", (F.col("best") & (F.col("copy") == 1)).alias("kept")
    )


def _form(text: Column) -> list[Column]:
    """What tells texts of one id apart: code points, digest of the normalised text, hash of the original."""
    raw = F.coalesce(text, F.lit(""))
    return [F.length(raw).cast("long").alias("n_chars"), F.sha2(normalised(text), 256).alias("text_sha256"), F.xxhash64(raw).alias("raw")]


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that agree in id and text one stays.

    Only rows that occur more than once are grouped, and tasks fold their own before the shuffle.
    """
    stay = materialize(duplicates(docs, text, doc_id, block).filter("kept"))
    form = ["n_chars", "text_sha256", "raw"]
    mine = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    field = lambda c: F.col("row").getField(c)
    mine = mine.select("row", field(doc_id).alias("id"), *_form(field(text)))

    def those(kept: DataFrame) -> DataFrame:
        kept = kept.select(F.col("doc_id").alias("stay"), *form)
        on = F.col("id").eqNullSafe(F.col("stay"))
        for c in form:
            on = on & (mine[c] == kept[c])
        return mine.join(kept, on, "left_semi")

    once = those(stay.filter("copies = 1")).select("row")
    often = those(stay.filter("copies > 1")).groupBy("id", *form).agg(F.first("row").alias("row")).select("row")
    return once.unionByName(often).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: equal texts of ``documents`` up to white space."""
    return duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents
), g AS (
  SELECT doc_id, t, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
         row_number() OVER (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST) AS nth,
         count(*) OVER (PARTITION BY t) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(t) AS text_sha256 FROM g
"""
