"""Benchmark decontamination: an FM-index for each shard of the corpus, searched for the phrases of a benchmark.

*Index.* A shard is a stretch of a partition's documents with about SHARD_WORDS words. Its words are numbered, every
document ends with a terminator of its own, and the suffixes are sorted by prefix doubling (only those still tied are
sorted again). Kept are the last column of the sorted suffixes as a wavelet tree (one bit vector a level, words of 64
bits with counts in front), the text positions of every SAMPLE-th word and of every document's first word, and the
vocabulary. The index knows nothing of the benchmark; it is written once and read by every block of phrases.

*Search.* Phrases are windows of ``width`` consecutive words of an item, or the whole item if it is shorter. They are
cut into blocks of about BLOCK_BYTES, which bounds the broadcast whatever the benchmark's size; a block is searched in
all shards at once. Backward search narrows a phrase's range of suffixes by two ranks a word; the rows of the ranges
walk left to the next sampled position, which locates them. A word sequence is compared by its words, never by a hash.

*Spans.* The words of all occurrences of a document are merged to removal spans, in the shard and then over blocks.

Words are runs of letters a-z, digits and characters from U+0080 on, after A-Z was lowered. A null text has no words; a
null item has none and is searched for nowhere. Every row of ``docs`` is a document of its own, so rows with one id or
no id stay apart; items with one id count once, and an item without an id is named by the empty text. Other columns of
both tables are ignored; only the names passed as parameters are read.
"""

from __future__ import annotations

import collections
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.session import materialize

WIDTH = 10
#: Words of a shard; one longer document is a shard of its own.
SHARD_WORDS = 1 << 20
#: Every so many words of the text, a suffix keeps its position.
SAMPLE = 4
#: Bytes of benchmark text that are broadcast at once, and the most words of one piece of an item.
BLOCK_BYTES, PIECE = 1 << 23, 4096

_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)

INDEX = "shard string, docs array<long>, lengths array<long>, vocabulary binary, tree binary, marks binary, places binary, zeros array<long>"


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split() if text else []


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``symbols``, in which every suffix meets a symbol that occurs once (its document's end)."""
    n = len(symbols)
    bits = max(1, int(symbols.max()).bit_length()) if n else 1
    depth = max(1, 62 // bits)
    padded = np.concatenate([symbols, np.zeros(depth, dtype=np.int64)])
    key = np.zeros(n, dtype=np.int64)
    for j in range(depth):
        key = (key << bits) | padded[j : j + n]
    order = np.argsort(key)
    rank = np.empty(n, dtype=np.int64)
    rows = np.arange(n)
    key = key[order]
    while True:
        new = np.ones(len(rows), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        rank[order[rows]] = np.maximum.accumulate(np.where(new, rows, 0))
        alone = new & np.append(new[1:], True)
        rows = rows[~alone]
        if not len(rows):
            return order
        at = order[rows]
        key = rank[at] * n + rank[at + depth]
        by = np.argsort(key)
        order[rows], key = at[by], key[by]
        depth *= 2


class Bits:
    """A bit vector with the number of ones before every place."""

    def __init__(self, words: np.ndarray):
        self.words = words
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)

    def ones(self, at: np.ndarray) -> np.ndarray:
        word, below = at >> 6, (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


def pack(bits: np.ndarray) -> np.ndarray:
    """Words of 64 bits, one more than needed so that the place after the last can be asked for."""
    out = np.zeros(len(bits) // 64 * 8 + 8, dtype=np.uint8)
    packed = np.packbits(bits, bitorder="little")
    out[: len(packed)] = packed
    return out.view("<u8")


class Shard:
    """The FM-index of a shard: ranges of suffixes by backward search, text positions by walking left."""

    def __init__(self, n: int, n_docs: int, n_words: int, tree: bytes, zeros: list[int], marks: bytes, places: bytes, sizes: np.ndarray):
        self.n, self.zeros, self.n_docs = n, zeros, n_docs
        each = (n // 64 + 1) * 8
        self.levels = [Bits(np.frombuffer(tree, "<u8", each // 8, i * each)) for i in range(len(zeros))]
        self.marks = Bits(np.frombuffer(marks, "<u8"))
        self.places = np.frombuffer(places, "<i4")
        self.first = np.concatenate([[0], n_docs + np.cumsum(sizes) - sizes])  # first suffix that begins with a word
        self.base = self._down(np.arange(n_words + 1), np.zeros(n_words + 1, dtype=np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, (level, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = level.ones(at)
            right = (symbol >> (len(self.zeros) - 1 - i)) & 1 == 1
            at = np.where(right, zeros + ones, at - ones)
        return at

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows before those that begin with ``symbol`` and go on like the rows before ``at``."""
        return self.first[symbol] + self._down(symbol, at) - self.base[symbol]

    def left(self, at: np.ndarray) -> np.ndarray:
        """The row of the suffix that begins one word earlier."""
        symbol = np.zeros(len(at), dtype=np.int64)
        for level, zeros in zip(self.levels, self.zeros):
            right, ones = level.get(at) == 1, level.ones(at)
            at = np.where(right, zeros + ones, at - ones)
            symbol = symbol * 2 + right
        return self.first[symbol] + at - self.base[symbol]

    def ranges(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of rows for each phrase; a row of ``phrases`` holds its words from the last to the first, 0 where it
        has none and -1 for a word that the shard has not."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        high[(phrases < 0).any(axis=1)] = 0
        for j in range(phrases.shape[1]):
            on = np.flatnonzero((low < high) & (lengths > j))
            if not len(on):
                break
            symbol = phrases[on, j]
            low[on], high[on] = self.step(symbol, low[on]), self.step(symbol, high[on])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows), dtype=np.int64)
        left, steps = np.arange(len(rows)), 0
        while len(left):
            marked = self.marks.get(rows) == 1
            out[left[marked]] = self.places[self.marks.ones(rows[marked])] + steps
            left, rows = left[~marked], rows[~marked]
            rows, steps = self.left(rows), steps + 1
        return out


def build(codes: np.ndarray, n_words: int) -> dict:
    """Parts of the index of a shard: ``codes`` are words from 1 on, with a 0 after every document."""
    n = len(codes)
    ends = codes == 0
    n_docs = int(ends.sum())
    symbols = codes.astype(np.int64) + n_docs - 1
    symbols[ends] = np.arange(n_docs)
    order = suffix_array(symbols)
    last = codes[order - 1]  # the first suffix of the text is after its last terminator, a 0 as well
    tree, zeros = [], []
    for bit in range(max(1, int(n_words).bit_length()) - 1, -1, -1):
        right = (last >> bit) & 1 == 1
        tree.append(pack(right))
        zeros.append(int(n - right.sum()))
        last = np.concatenate([last[~right], last[right]])
    starts = np.concatenate([[True], ends[:-1]])
    marked = ((np.arange(n) % SAMPLE == 0) | starts)[order]
    return {
        "tree": np.concatenate(tree).tobytes(),
        "zeros": zeros,
        "marks": pack(marked).tobytes(),
        "places": order[marked].astype("<i4").tobytes(),
    }


def _shards(shard_words: int):
    schema = pa.schema(
        [("shard", pa.string()), ("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("vocabulary", pa.binary()),
         ("tree", pa.binary()), ("marks", pa.binary()), ("places", pa.binary()), ("zeros", pa.list_(pa.int64()))]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), itertools.count()
        vocabulary = collections.defaultdict(itertools.count(1).__next__)
        docs, lengths, codes, size = [], [], [], 0

        def written() -> pa.RecordBatch:
            nonlocal vocabulary, docs, lengths, codes, size
            parts = build(np.concatenate(codes), len(vocabulary))
            row = {"shard": f"{part}-{next(number)}", "docs": docs, "lengths": lengths, "vocabulary": b" ".join(vocabulary), **parts}
            vocabulary = collections.defaultdict(itertools.count(1).__next__)
            docs, lengths, codes, size = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text")):
                words = split_words(text.as_py())
                if docs and size + len(words) > shard_words:
                    yield written()
                found = np.zeros(len(words) + 1, dtype=np.int32)
                found[:-1] = np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words))
                docs.append(doc)
                lengths.append(len(words))
                codes.append(found)
                size += len(words)
        if docs:
            yield written()

    return scan


def index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shard_words: int = SHARD_WORDS) -> DataFrame:
    """The FM-indexes of ``docs``, one row a shard; written to the shared folder."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    return materialize(rows.mapInArrow(_shards(shard_words), INDEX))


class Phrases:
    """A block of phrases: distinct windows of words, and the items that hold each."""

    def __init__(self, pieces: list[tuple[str, list[str]]], width: int):
        words = collections.defaultdict(itertools.count().__next__)
        windows = collections.defaultdict(itertools.count().__next__)
        self.items = sorted({item for item, _ in pieces})
        number = {item: i for i, item in enumerate(self.items)}
        pairs = set()
        for item, piece in pieces:
            codes = [words[w.encode("utf-8", "surrogatepass")] for w in piece]
            for i in range(max(1, len(codes) - width + 1)):
                pairs.add((windows[tuple(codes[i : i + width][::-1])], number[item]))
        self.words = list(words)
        self.lengths = np.array([len(w) for w in windows], dtype=np.int64)
        self.codes = np.zeros((len(windows), width), dtype=np.int64)
        for i, window in enumerate(windows):
            self.codes[i, : len(window)] = window
        self.windows, self.of_item = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2).T
        self.first = np.searchsorted(self.windows, np.arange(len(windows) + 1))


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range of each."""
    many = high - low
    of = np.repeat(np.arange(len(low)), many)
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + low[of], of


def _merged(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each text, those that overlap or touch as one."""
    by = np.lexsort((begin, text))
    text, begin, end = text[by], begin[by], end[by]
    shift = text * (int(end.max(initial=0)) + 2)
    reach = np.maximum.accumulate(end + shift)
    new = np.ones(len(text), dtype=bool)
    new[1:] = begin[1:] + shift[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(text)) - 1
    return text[at], begin[at], reach[last] - shift[last] if len(at) else end


def _search(shared, whole: bool):
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
    schema = pa.schema(
        [("shard", pa.string()), ("place", pa.int32()), ("doc", pa.int64()), ("n_words", pa.int64()),
         ("spans", pa.list_(span)), ("items", pa.list_(pa.string()))]
    )

    def one(row: dict) -> pa.RecordBatch:
        phrases = shared.value
        lengths = np.array(row["lengths"], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        vocabulary = {w: i for i, w in enumerate(row["vocabulary"].split(b" "), 1)} if row["vocabulary"] else {}
        spans: dict[int, list] = collections.defaultdict(list)
        items: dict[int, list] = {}
        known = np.array([vocabulary.get(w, -1) for w in phrases.words], dtype=np.int64)
        if len(phrases.codes) and vocabulary:
            inside = np.arange(phrases.codes.shape[1]) < phrases.lengths[:, None]
            codes = np.where(inside, known[phrases.codes], 0)
            asked = np.flatnonzero((codes >= 0).all(axis=1))
            shard = Shard(int(starts[-1]), len(lengths), len(vocabulary), row["tree"], row["zeros"], row["marks"], row["places"], _sizes(row, len(vocabulary)))
            low, high = shard.ranges(codes[asked], phrases.lengths[asked])
            rows, of = _spread(low, high)
            window = asked[of]
            place = shard.locate(rows)
            text = np.searchsorted(starts, place, "right") - 1
            begin = place - starts[text]
            for t, b, e in zip(*_merged(text, begin, begin + phrases.lengths[window])):
                spans[int(t)].append({"begin": int(b), "end": int(e)})
            pairs = np.unique(text * len(phrases.codes) + window)
            text, window = pairs // len(phrases.codes), pairs % len(phrases.codes)
            at, of = _spread(phrases.first[window], phrases.first[window + 1])
            pairs = np.unique(text[of] * len(phrases.items) + phrases.of_item[at])
            for t, group in itertools.groupby(pairs.tolist(), lambda p: p // len(phrases.items)):
                items[t] = [phrases.items[p % len(phrases.items)] for p in group]
        told = list(range(len(lengths))) if whole else sorted(spans)
        columns = {
            "shard": [row["shard"]] * len(told),
            "place": told,
            "doc": [row["docs"][t] for t in told],
            "n_words": lengths[told],
            "spans": [spans.get(t, []) for t in told],
            "items": [items.get(t, []) for t in told],
        }
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield one(batch.slice(i, 1).to_pylist()[0])

    return scan, "shard string, place int, doc long, n_words long, spans array<struct<begin:long,end:long>>, items array<string>"


def _sizes(row: dict, n_words: int) -> np.ndarray:
    """Occurrences of every word, from the tree: the lowest level is sorted by bit-reversed symbols."""
    n = sum(row["lengths"]) + len(row["lengths"])
    each = n // 64 + 1
    low = np.zeros(1, dtype=np.int64)
    high = np.full(1, n, dtype=np.int64)
    symbol = np.zeros(1, dtype=np.int64)
    for i, zeros in enumerate(row["zeros"]):
        level = Bits(np.frombuffer(row["tree"], "<u8", each, i * each * 8))
        a, b = level.ones(low), level.ones(high)
        low, high = np.concatenate([low - a, zeros + a]), np.concatenate([high - b, zeros + b])
        symbol = np.concatenate([symbol * 2, symbol * 2 + 1])
        some = high > low
        low, high, symbol = low[some], high[some], symbol[some]
    sizes = np.zeros(n_words + 1, dtype=np.int64)
    sizes[symbol] = high - low
    return sizes[1:]


def pieces(benchmark: DataFrame, text: str = "text", item_id: str = "item_id", width: int = WIDTH) -> DataFrame:
    """Items in pieces of PIECE windows: item, words. Neighbouring pieces share ``width - 1`` words."""
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    words = F.regexp_extract_all(F.translate(text, upper, lower), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words.alias("all")).filter("size(all) > 0")
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.size("all") - width, F.lit(0)) / PIECE).cast("int"))
    items = items.select("item", "all", F.explode(starts).alias("i"))
    return items.select("item", F.slice("all", F.col("i") * PIECE + 1, F.lit(PIECE + width - 1)).alias("words"))


def search(shards: DataFrame, phrases: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document of the index: doc_id, n_words, spans (merged, of words), items (sorted names)."""
    spark = shards.sparkSession
    phrases = materialize(phrases.withColumn("key", F.xxhash64("item", "words")))
    size = phrases.agg(F.sum(F.length(F.to_json("words")))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    found = None
    for i in range(n_blocks):
        block = phrases.filter(F.pmod("key", F.lit(n_blocks)) == i).collect()
        scan, schema = _search(spark.sparkContext.broadcast(Phrases([(r["item"], r["words"]) for r in block], width)), i == 0)
        rows = shards.mapInArrow(scan, schema)
        rows = rows if n_blocks == 1 else materialize(rows)
        found = rows if found is None else found.union(rows)
    if n_blocks > 1:
        found = found.groupBy("shard", "place").agg(
            F.first("doc").alias("doc"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        )
        found = found.withColumn("spans", F.expr(_MERGE))
    return found.select(F.col("doc").alias("doc_id"), "n_words", "spans", F.array_sort("items").alias("items"))


#: Spans of several blocks, sorted, those that overlap or touch as one.
_MERGE = """aggregate(array_sort(spans), cast(array() as array<struct<begin:bigint,end:bigint>>), (done, x) ->
  if(size(done) > 0 and x.begin <= element_at(done, -1).end,
     concat(slice(done, 1, size(done) - 1),
            array(named_struct('begin', element_at(done, -1).begin, 'end', greatest(element_at(done, -1).end, x.end)))),
     concat(done, array(named_struct('begin', x.begin, 'end', x.end)))))"""


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Removal spans of every row of ``docs`` (text, doc_id) for the items of ``benchmark`` (text, item_id)."""
    return search(index(docs), pieces(benchmark, width=width), width)


def query(spark, sf_dir: str) -> DataFrame:
    """op13: occurrences of ten-word windows of ``benchmark`` in ``documents``."""
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["begin"])
    names = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return out.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), names.alias("items_sha256"), (hit > 0).alias("contaminated")
    )


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item, least(10, len(w)) AS m, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM bw),
one AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
ten AS (SELECT r, i, list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ws FROM one),
hit AS (SELECT r, i, t.m, item FROM (SELECT r, i, m, array_to_string(ws[1:m], ' ') AS phrase FROM ten, (SELECT DISTINCT m FROM win) WHERE len(ws) >= m) t JOIN win USING (m, phrase)),
hits AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS k FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN its USING (r)
"""
