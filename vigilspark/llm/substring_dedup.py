"""Exact substring dedup: remove the words of every long repeat, by seed and extend.

*Seed.* Every window of ``length`` words picks one anchor: its smallest ``gram``-word hash, leftmost of ties
(winnowing). Equal windows pick the same anchor, so repeats are found by joining on anchors; about two in
``length - gram + 2`` words are anchors.

*Extend.* The windows that picked one anchor are consecutive: a run of windows around it. Where all
occurrences of an anchor have the same run, the run is the common stretch, as far to both sides as this anchor
answers for. Otherwise each occurrence is compared window by window with all others. Both comparisons are
equalities of 96 bits (half the anchor's hash, and the stretch's), counted over the corpus, so a passage with m copies costs m rows
and never m squared pairs. Neighbouring repeated windows merge to maximal repeats.

Anchors that occur once need no comparison. Two fixed-size bitmaps (``bitmaps``) carry what is repeated back to
the texts; they save work and decide nothing.

Nulls and empty texts have no words and keep nothing. Rows are told apart by id and text, so repeated ids are
independent documents, and repeated rows are copies of one another: all their long windows repeat. Any other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.llm import bitmaps
from vigilspark.llm.words import Words, grouped, sliding_min
from vigilspark.session import materialize

GRAM = 6
_LOW = np.uint64((1 << 30) - 1)


def runs(words: Words, length: int, gram: int) -> dict[str, np.ndarray]:
    """Runs of windows that share an anchor: text, first window (word of the group), windows, anchor."""
    n = len(words.starts) - length + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return {"text": none, "begin": none, "windows": none, "anchor": none.view(np.uint64)}
    grams = words.windows(gram)
    keys = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    picked = (sliding_min(keys, length - gram + 1) & _LOW).astype(np.int64)[:n]
    whole = np.flatnonzero(words.text_of[:n] == words.text_of[length - 1 :])
    picked = picked[whole]
    new = np.ones(len(whole), dtype=bool)
    new[1:] = (picked[1:] != picked[:-1]) | (whole[1:] != whole[:-1] + 1)
    at = np.flatnonzero(new)
    return {
        "text": words.text_of[whole[at]],
        "begin": whole[at],
        "windows": np.diff(np.append(at, len(whole))),
        "anchor": grams[picked[at]],
    }


def _stretches(length: int, gram: int):
    schema = pa.schema([("anchor", pa.int64()), ("stretch", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in grouped(batch.column("text").to_pylist()):
                words = Words(texts)
                r = runs(words, length, gram)
                stretch = words.hashes(r["begin"], r["begin"] + r["windows"] + length - 2)
                columns = {"anchor": r["anchor"].view(np.int64), "stretch": stretch.view(np.int64)}
                yield from bitmaps.arrow([columns], schema)

    return scan


def _candidates(length: int, gram: int, repeated, mixed):
    schema = pa.schema(
        [("doc", pa.int64()), ("form", pa.int64()), ("anchor", pa.int32()), ("stretch", pa.int64()),
         ("begin", pa.int32()), ("windows", pa.int32())]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, many = repeated.value, mixed.value
        for batch in batches:
            ids = batch.column("doc").to_pylist()
            forms = batch.column("form").to_numpy(zero_copy_only=False)
            for offset, texts in grouped(batch.column("text").to_pylist()):
                words = Words(texts)
                r = runs(words, length, gram)
                at = bitmaps.slots(r["anchor"])
                seen = bitmaps.test(some, at)
                apart = bitmaps.test(many, at[seen])
                r = {k: v[seen] for k, v in r.items()}
                one = {k: v[~apart] for k, v in r.items()}
                times = r["windows"][apart]
                each = {k: np.repeat(v[apart], times) for k, v in r.items()}
                each["begin"] = each["begin"] + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                each["windows"] = np.ones(len(each["begin"]), dtype=np.int64)
                r = {k: np.concatenate([one[k], each[k]]) for k in r}
                text = r["text"] + offset
                yield from bitmaps.arrow(
                    [
                        {
                            "doc": [ids[i] for i in text.tolist()],
                            "form": forms[text],
                            "anchor": r["anchor"].view(np.int64).astype(np.int32),
                            "stretch": words.hashes(r["begin"], r["begin"] + r["windows"] + length - 2).view(np.int64),
                            "begin": (r["begin"] - words.first[r["text"]]).astype(np.int32),
                            "windows": r["windows"].astype(np.int32),
                        }
                    ],
                    schema,
                )

    return scan, "doc long, form long, anchor int, stretch long, begin int, windows int"


def _cut(length: int):
    schema = pa.schema(
        [("doc", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()),
         ("spans", pa.list_(pa.list_(pa.int32())))]
    )

    def one(text: str | None, begins: list[int] | None, windows: list[int] | None) -> tuple:
        words = text.encode("utf-8", "surrogatepass").split() if text else []
        if not begins:
            return len(words), 0, b" ".join(words), []
        order = np.argsort(begins)
        begin = np.array(begins)[order]
        end = np.maximum.accumulate(begin + np.array(windows)[order] + length - 1)
        new = np.flatnonzero(np.append(True, begin[1:] > end[:-1]))
        spans = [[int(begin[a]), int(end[b - 1])] for a, b in zip(new, np.append(new[1:], len(begin)))]
        kept, at = [], 0
        for a, b in spans:
            kept += words[at:a]
            at = b
        kept += words[at:]
        return len(words), len(words) - len(kept), b" ".join(kept), spans

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, begins, windows = (batch.column(c).to_pylist() for c in ("text", "begins", "windows"))
            done = [one(*x) for x in zip(texts, begins, windows)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc"),
                    pa.array([x[0] for x in done], pa.int64()),
                    pa.array([x[1] for x in done], pa.int64()),
                    pa.array([x[2].decode("utf-8", "surrogatepass") for x in done], pa.string()),
                    pa.array([x[3] for x in done], schema.field("spans").type),
                ],
                schema=schema,
            )

    return scan


def remove_repeats(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = 35, gram: int = GRAM
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (words joined by one space), spans (the
    maximal repeats, as first word and word after the last).

    A word goes if a window of ``length`` words that covers it starts at another place too.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(text).alias("form"), F.col(text).alias("text"))

    stretches = rows.select("text").mapInArrow(_stretches(length, gram), "anchor long, stretch long")
    repeated = materialize(
        stretches.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("n"), F.min("stretch").alias("lo"), F.max("stretch").alias("hi"))
        .filter("n > 1")
        .select("anchor", (F.col("lo") != F.col("hi")).alias("mixed"))
    )
    some = spark.sparkContext.broadcast(bitmaps.pack(bitmaps.gather(repeated, "anchor")))
    many = spark.sparkContext.broadcast(bitmaps.pack(bitmaps.gather(repeated.filter("mixed"), "anchor")))

    scan, schema = _candidates(length, gram, some, many)
    candidates = rows.mapInArrow(scan, schema)  # read twice: hashing again is cheaper than keeping a row per window
    keys = materialize(
        candidates.groupBy("anchor", "stretch").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor", "stretch")
    )
    found = candidates.join(keys, ["anchor", "stretch"], "left_semi")
    per_text = found.groupBy("doc", "form").agg(
        F.collect_list(F.struct("begin", "windows")).alias("at")  # no longer than the text itself
    )
    per_text = per_text.select(
        F.col("doc").alias("doc_"), F.col("form").alias("form_"), F.col("at.begin").alias("begins"), F.col("at.windows").alias("windows")
    )
    marked = rows.join(per_text, F.col("doc").eqNullSafe(F.col("doc_")) & (F.col("form") == F.col("form_")), "left")
    out = marked.select("doc", "text", "begins", "windows").mapInArrow(
        _cut(length), "doc long, n_words long, n_removed long, kept string, spans array<array<int>>"
    )
    return out.withColumnRenamed("doc", doc_id)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: 35-word repeats of ``documents``, as digests of what is kept."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), length=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
