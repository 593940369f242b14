"""Similarity join on word n-grams: all documents whose shingle sets have a Jaccard similarity of at least 80 %.

Sets are sorted rare shingles first. Two similar sets share a shingle in their prefixes, the first fifth, so only
prefixes are joined; the first shingle they share leaves at least the overlap needed, which the length and positional
filters test on the joined rows, and the suffix filter bounds the overlap of what is left by counts per class of
shingles; a set has a class for every four shingles. What passes is verified on whole sets, once per pair.

The order needs frequencies that are the same everywhere, not exact ones: a sketch of fixed size counts shingles by
hash slot, which puts boilerplate last whatever the corpus. Shingles that occur in one prefix only are dropped early
with a fixed-size bitmap (``bitmaps``). Sketch and bitmap take different bits of a hash: prefixes crowd where the sketch
counts little, and would crowd in the bitmap as well.

Equal sets are one node, so copies cost a row each; postings hold a node's number, not its name. Groups of near copies
are not expanded to pairs: rounds join every
node of a posting list with its first few nodes, a few more each round, unless they are known to be connected. A node
meets those before it, so a list that is not longer than the nodes taken so far has had all its pairs and is left out
from then on; most lists are short. The first round's node comes with the count that tells lists from single entries, so
lists of two are never written. The last round joins what is left of the long ones, and only nodes that are not yet
known to be connected, so no link that joins two groups is missed. All rounds meet a pair where a run of shared shingles
begins (an entry knows the one before it) and not at each of them. The last one tests a node against a group's extremes
first. It also compares parities: the shingles of a set are counted in PARITIES classes, one bit each, odd or even. Two sets differ by at
least as many shingles as they have bits that differ, and similar ones by at most a ninth of both sizes, so holders of
one passage that stay just under the threshold are not joined with each other one by one. Joins on postings are of written tables on both sides, whose hot keys Spark splits. Tables are removed once nothing reads
them any more.

Nulls and texts without words have no shingles and are linked with nothing; a text of fewer than ``width`` words is
one shingle. Components carry the smallest id; null ids are carried by none. Repeated rows are copies of each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.llm import bitmaps, workers
from vigilspark.llm.components import components
from vigilspark.llm.words import Words, grouped
from vigilspark.session import discard, materialize

WIDTH = 5
#: Slots of the frequency sketch: 2**18 counters.
SKETCH_BITS = 18
#: Most classes of the suffix filter, and the count that means as many or more.
MOST_CLASSES, MANY = 1 << 16, 255
#: Bits of a shingle's hash that tell which occur in several prefixes; fewer bytes to shuffle, and chance hits do no harm.
SHARED_BITS = 40
#: First nodes of a list that the others have met after each round, one in the first; the last round takes the pairs of all others.
CENTRES = (1, 5)
#: Bits of the parities, and their number of longs.
PARITY_BITS = 9
WORDS = range((1 << PARITY_BITS) // 64)
#: An entry's columns and their names for a node that others meet.
CENTRE = {"node": "other", "n": "m", "place": "at", "before": "before_2"}


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, sorted."""
    words = Words(texts, lower=True)
    windows = words.windows(width)
    out = []
    for n, first in zip(words.counts.tolist(), words.first.tolist()):
        if n >= width:
            out.append(np.unique(windows[first : first + n - width + 1]))
        elif n:
            out.append(words.hashes(np.array([first]), np.array([first + n - 1])))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def _name(shingles: np.ndarray) -> bytes:
    """Name of a set: equal for equal sets alone."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _classes(shingles: np.ndarray) -> bytes:
    """Shingles of each class, a byte each; a power of two of classes, so that those of two sets can be matched."""
    most = min(1 << max(len(shingles) // 4, 16).bit_length(), MOST_CLASSES)
    return np.minimum(np.bincount((shingles % most).astype(np.int64), minlength=most), MANY).astype(np.uint8).tobytes()


def _counter(shingles: np.ndarray) -> np.ndarray:
    """Counter of the sketch: the lower bits of a hash, since ``bitmaps`` takes the upper ones."""
    return (shingles & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)


def _common(a: bytes, b: bytes) -> int:
    """The most shingles that two sets can share by their classes; without a bound, as many as there may be."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if x.max() == MANY or y.max() == MANY:
        return np.iinfo(np.int32).max
    k = min(len(x), len(y))
    fold = (z.reshape(-1, k).sum(axis=0, dtype=np.int64) for z in (x, y))
    return int(np.minimum(*fold).sum())


def _parities(shingles: np.ndarray) -> np.ndarray:
    """Whether each class of shingles holds an odd number of them, 64 classes a long."""
    odd = np.bincount(bitmaps.slots(shingles, PARITY_BITS), minlength=1 << PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


@workers.lean
def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        most = list(map(_common, batch.column("classes_a").to_pylist(), batch.column("classes_b").to_pylist()))
        kept = batch.select(["a", "b", "n_a", "n_b", "key_a", "key_b", "name_a", "name_b"])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(most, pa.int32())], names=[*kept.schema.names, "most"])


def _prefix(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles in the order rare first, by sketched count and hash."""
    order = np.lexsort((shingles, counts[_counter(shingles)]))
    return shingles[order[: prefix_length(len(shingles))]]


def _sketch(width: int):
    @workers.lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            for _, texts in grouped(batch.column("text").to_pylist()):
                sets = shingle_sets(texts, width)
                counts += np.bincount(_counter(np.concatenate(sets)), minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["slot", "n"])

    return scan


def _prefixes(width: int, sketch):
    @workers.lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in grouped(batch.column("text").to_pylist()):
                found = [_prefix(s, sketch.value) for s in shingle_sets(texts, width) if len(s)]
                if found:
                    upper = np.concatenate(found) >> np.uint64(64 - SHARED_BITS)
                    yield pa.RecordBatch.from_arrays([pa.array(upper.view(np.int64))], names=["upper"])

    return scan


def _nodes(width: int, sketch, shared):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("name", pa.binary()),
         ("tokens", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("classes", pa.binary()),
         ("parities", pa.list_(pa.int64()))]
    )

    @workers.lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in grouped(batch.column("text").to_pylist()):
                sets = shingle_sets(texts, width)
                tokens, places = [], []
                for s in sets:
                    prefix = _prefix(s, sketch.value) if len(s) else s
                    at = np.flatnonzero(bitmaps.test(shared.value, bitmaps.slots(prefix)))
                    tokens.append(prefix[at].view(np.int64))
                    places.append(at.astype(np.int32))
                classes = [_classes(s) if len(t) else None for s, t in zip(sets, tokens)]
                parities = [_parities(s) if len(t) else None for s, t in zip(sets, tokens)]
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("key"), pa.array([len(s) for s in sets], pa.int32()),
                        pa.array(map(_name, sets), pa.binary()), pa.array(tokens, schema.field("tokens").type),
                        pa.array(places, schema.field("places").type), pa.array(classes, schema.field("classes").type),
                        pa.array(parities, schema.field("parities").type),
                    ],
                    schema=schema,
                )

    return scan, "doc_id long, key long, n int, name binary, tokens array<long>, places array<int>, classes binary, parities array<long>"


def _sets(width: int, wanted):
    schema = pa.schema([("name", pa.binary()), ("shingles", pa.list_(pa.int64()))])

    @workers.lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.flatnonzero(bitmaps.test(wanted.value, bitmaps.slots(batch.column("key").to_numpy())))
            for _, texts in grouped(batch.column("text").take(pa.array(at)).to_pylist()):
                sets = [s for s in shingle_sets(texts, width) if len(s)]
                columns = [pa.array(map(_name, sets), pa.binary()), pa.array([s.view(np.int64) for s in sets], schema.field("shingles").type)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return scan, "name binary, shingles array<long>"


def _enough(overlap: Column, n: Column, m: Column) -> Column:
    """Whether an overlap makes 80 %: 100 o >= 80 (n + m - o)."""
    return 9 * overlap >= 4 * (n + m)


def _reaches(n: Column, place: Column, m: Column) -> Column:
    """Whether a set of ``n`` has ``_enough`` from ``place`` on for one of ``m``."""
    return 4 * m + 9 * place <= 5 * n


def _may_match(n: Column, place: Column, m: Column, other: Column) -> Column:
    """Length and positional filter of two prefix entries with the same shingle."""
    return _reaches(n, place, m) & _reaches(m, other, n)


def _extremes(entries: DataFrame) -> DataFrame:
    """Each group of a list: its smallest and largest set, first place, the entry before, if all have the same, and the
    parities that all of its sets or any of them have."""
    same = (F.min("before") == F.max("before")) & (F.count("before") == F.count(F.lit(1)))
    return entries.groupBy("token", "comp").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.min("place").alias("start"), F.when(same, F.min("before")).alias("all_before"),
        *[F.bit_and(f"p{i}").alias(f"all{i}") for i in WORDS], *[F.bit_or(f"p{i}").alias(f"any{i}") for i in WORDS],
    )


def _few_apart(differ: list[Column], n: Column, m: Column) -> Column:
    """Whether two sets may be similar by the parities that differ, a long each: at most (n + m) / 9."""
    return 9 * reduce(add, map(F.bit_count, differ)).cast("long") <= n + m


def _new_run(before: Column, other: Column) -> Column:
    """Whether a run of shared shingles begins here; if both have the same entry before, that one is shared as well."""
    return F.coalesce(before != other, F.lit(True))


def _pairs(rows: DataFrame) -> DataFrame:
    """Each pair of ``node`` and ``other`` once, as a < b."""
    return rows.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _links(pairs: DataFrame, sizes: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """The pairs that are similar: suffix filter, then whole sets of the documents that are left."""

    some = pairs
    for side in ("a", "b"):
        columns = [F.col(c).alias(f"{c}_{side}") for c in ("n", "key", "name", "classes")]
        some = some.join(sizes.select(F.col("node").alias(side), *columns), side)
    some = some.mapInArrow(_bounds, "a long, b long, n_a int, n_b int, key_a long, key_b long, name_a binary, name_b binary, most int")
    some = materialize(some.filter(_enough(F.col("most").cast("long"), F.col("n_a"), F.col("n_b"))).drop("most"))
    keys = some.select(F.explode(F.array("key_a", "key_b")).alias("key"))
    scan, schema = _sets(width, rows.sparkSession.sparkContext.broadcast(bitmaps.pack(bitmaps.gather(keys, "key"))))
    sets = materialize(rows.select("key", "text").mapInArrow(scan, schema))
    whole = some
    for side in ("a", "b"):
        whole = whole.join(sets.select(F.col("name").alias(f"name_{side}"), F.col("shingles").alias(f"shingles_{side}")), f"name_{side}")
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    found = materialize(whole.filter(_enough(common, F.col("n_a"), F.col("n_b"))).select("a", "b", "name_a", "name_b"))
    discard(pairs, some, sets)
    return found


def _centres(entries: DataFrame, met: int, most: int) -> DataFrame:
    """Of each list, the nodes from number ``met`` to ``most``, in the order of their numbers, the same in all lists."""
    nth = F.row_number().over(Window.partitionBy("token").orderBy("node"))
    first = entries.withColumn("nth", nth).filter(F.col("nth") <= most).filter(F.col("nth") > met)
    return first.select("token", F.col("comp").alias("c"), *[F.col(x).alias(name) for x, name in CENTRE.items()])


def _meets() -> Column:
    """Whether an entry and a centre of its list may be similar, and their run of shared shingles begins here."""
    return _may_match(F.col("n"), F.col("place"), F.col("m"), F.col("at")) & _new_run(F.col("before"), F.col("before_2"))


def _labelled(postings: DataFrame, labels: DataFrame) -> DataFrame:
    return postings.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def links(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Nodes (doc_id, key, n, name; a row for each document) and links (a, b) enough to connect all similar nodes.

    Not every link: pairs that are connected already are not compared, so no document's number of links follows.
    """
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(doc_id, text).alias("key"), F.col(text).alias("text"))

    counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    slots = rows.select("text").mapInArrow(_sketch(width), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts[slots["slot"]] = slots["n"]  # one row for each slot
    sketch = share(counts)
    upper = rows.select("text").mapInArrow(_prefixes(width, sketch), "upper long")
    often = upper.groupBy("upper").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = share(bitmaps.pack(bitmaps.gather(often.select(F.shiftleft("upper", 64 - SHARED_BITS).alias("token")), "token")))
    scan, schema = _nodes(width, sketch, shared)
    whole = materialize(rows.mapInArrow(scan, schema))

    first = F.min(F.struct("key", "n", "tokens", "places", "classes", "parities")).alias("x")  # one document stands for equal sets
    reps = whole.filter(F.size("tokens") > 0).groupBy("name").agg(first)
    reps = materialize(reps.select(F.monotonically_increasing_id().alias("node"), "name", "x.*"))  # written, so the numbers stay
    nodes = materialize(whole.select("doc_id", "key", "n", "name"))
    discard(whole)
    sizes = reps.select("node", "name", "n", "key", "classes")
    before = F.concat(F.array(F.lit(None).cast("long")), F.slice("tokens", 1, F.size("tokens") - 1))
    entries = reps.select("node", "n", F.explode(F.arrays_zip("tokens", "places", before.alias("before"))).alias("e"))
    entries = entries.select("node", "n", F.col("e.tokens").alias("token"), F.col("e.places").alias("place"), F.col("e.before").alias("before"))
    centre = F.struct(*[F.col(x).alias(name) for x, name in CENTRE.items()])
    lists = entries.groupBy("token").agg(F.count(F.lit(1)).cast("int").alias("length"), F.min(centre).alias("x"))
    lists = materialize(lists.filter("length > 1").select("token", "length", "x.*"))
    fits = (F.col("node") > F.col("other")) & _meets()
    postings = entries.join(lists, "token").select(*entries.columns, "length", F.when(fits, F.col("other")).alias("other"))
    postings = materialize(postings.filter((F.col("length") > CENTRES[0] + 1) | F.col("other").isNotNull()))
    discard(lists)

    found = spark.createDataFrame([], "a long, b long, name_a binary, name_b binary")
    pairs = materialize(_pairs(postings.filter("other IS NOT NULL")))
    for met, most in zip(CENTRES, (*CENTRES[1:], None)):  # every node with some nodes of each list it stands in
        found = found.union(_links(pairs, sizes, rows, width))
        unmet = postings.filter(F.col("length") > met + 1).select(*entries.columns, "length")  # two nodes at least that haven't met
        old, postings = postings, materialize(_labelled(unmet, components(found)))  # once for both readers
        discard(old)
        apart = postings
        if most:
            centres = materialize(_centres(apart, met, most))
            mine, other = F.col("node") > F.col("other"), F.col("comp") != F.col("c")
            pairs = materialize(_pairs(apart.join(centres, "token").filter(mine & other & _meets())))
            discard(centres)

    # what is not connected yet, by lists with several components
    several = apart.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("token")
    parities = reps.select("node", *[F.col("parities")[i].alias(f"p{i}") for i in WORDS])
    left = materialize(apart.drop("length").join(several, "token", "left_semi").join(parities, "node"))
    groups = materialize(_extremes(left))
    discard(postings)
    own = [f"p{i}" for i in WORDS]
    right = left.select("token", F.col("comp").alias("c"), *[F.col(x).alias(f"{x}_2") for x in ("node", "n", "place", "before", *own)])
    with_group = _reaches(F.col("n"), F.col("place"), F.col("low")) & _reaches(F.col("high"), F.col("start"), F.col("n"))
    apart_all = [(F.col(f"all{i}").bitwiseAND(F.bitwise_not(f"p{i}"))).bitwiseOR(F.col(f"p{i}").bitwiseAND(F.bitwise_not(f"any{i}"))) for i in WORDS]
    with_group &= _few_apart(apart_all, F.col("n"), F.col("high"))
    cross = left.join(groups.withColumnRenamed("comp", "c"), "token").filter((F.col("comp") < F.col("c")) & with_group & _new_run(F.col("before"), F.col("all_before")))
    cross = cross.select(*left.columns, "c").join(right, ["token", "c"])
    with_node = _few_apart([F.col(f"p{i}").bitwiseXOR(F.col(f"p{i}_2")) for i in WORDS], F.col("n"), F.col("n_2"))
    cross = cross.filter(_may_match(F.col("n"), F.col("place"), F.col("n_2"), F.col("place_2")) & with_node & _new_run(F.col("before"), F.col("before_2")))
    pairs = materialize(_pairs(cross.withColumnRenamed("node_2", "other")))
    discard(groups, left)
    found = found.union(_links(pairs, sizes, rows, width))
    return nodes, found.select(F.col("name_a").alias("a"), F.col("name_b").alias("b"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, key, n_shingles, component_id, kept (one of each component: the smallest id)."""
    nodes, found = links(docs, text, doc_id, width)
    labels = components(found).withColumnRenamed("node", "name")
    rows = materialize(nodes.join(labels, "name", "left").withColumn("comp", F.coalesce("comp", "name")).drop("name"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "key"))).alias("first")
    any_ = F.min("key").alias("any")
    groups = materialize(rows.filter("n > 0").groupBy("comp").agg(first, any_))
    some = rows.filter("n > 0").join(groups, "comp")
    best = F.when(F.col("first").isNull(), F.col("key") == F.col("any")).otherwise(
        F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    )
    some = some.select("doc_id", "key", "n", F.col("first.doc_id").alias("component_id"), best.alias("kept"))
    none = rows.filter("n = 0").select("doc_id", "key", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return some.union(none).withColumn("n_shingles", F.col("n").cast("long")).drop("n")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, and all without words; of repeated rows one stays."""
    out = near_duplicates(docs, text, doc_id, width).filter("NOT kept").select(F.col("key").alias("_key"), F.col("doc_id").alias("_id"))
    mine = docs.withColumn("_k", F.xxhash64(doc_id, text))
    mine = mine.join(out.distinct(), (F.col("_k") == F.col("_key")) & F.col(doc_id).eqNullSafe(F.col("_id")), "left_anti")
    words = F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    first = Window.partitionBy(doc_id, "_k").orderBy(F.lit(0))
    mine = mine.withColumns({"_words": words, "_nth": F.row_number().over(first)})
    return mine.filter("_nth = 1 OR NOT _words").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op3: components of ``documents`` by 5-word shingles and a Jaccard similarity of 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
