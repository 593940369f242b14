"""Spelling variant grouping: k-d trees over letter-count vectors, searched for words one edit away.

One inserted or deleted letter changes one letter count by one; a replaced letter takes one from a count and adds one to
another. So all near words of a word lie in a box of L1 radius one (length plus one) or two (same length) around its
letter counts. For every word length there is a k-d tree whose planes split one letter's count. A word is a point of the
tree of its length and asks two trees, its own and that of the next length, with one letter to add and, in its own
length, one to take away: it goes down both sides of a plane only if a letter that it still may add or take lets it
cross. So each pair of lengths is searched once. Where the box and a leaf meet, the counts are compared, and then the
order of the letters decides.

The upper planes are fitted on a bounded sample of the vocabulary (SAMPLE words of at most LONGEST letters, picked by
hash) and broadcast; they say where a word is looked for, never whether it is found. Each upper leaf is a key of a
shuffle; one with more than LEAF words is cut into slices by hash, and its questions go to every slice. A task holds
the words of one slice, builds the lower tree on them, and lets the questions stream by.

A word's form is its near word with the most occurrences, if it has RATIO times the word's own; forms grow by that
ratio, so a chain of them is short and is followed by pointer doubling.

Words are any non-empty texts; code points are letters (256 classes of them make the vector, which only coarsens it).
Null texts have no words, a null id counts as an empty one, rows with one id or none stay apart, other columns are
ignored, an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.session import materialize

SAMPLE, LONGEST = 1 << 16, 64
#: Words of an upper leaf that a task holds at once, and of a lower leaf.
LEAF, SMALL = 4096, 24
RATIO = 5
#: Counts up to which planes are tried for every letter.
USUAL = 3
#: Classes of letters, and the most numbers that are compared at once.
CLASSES, CHUNK = 256, 1 << 22


def letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1)


def vectors(codes: np.ndarray) -> np.ndarray:
    """Letter counts of each row."""
    rows = np.arange(len(codes))[:, None] * CLASSES
    return np.bincount((rows + codes % CLASSES).ravel(), minlength=len(codes) * CLASSES).reshape(-1, CLASSES).astype(np.int32)


def parities(points: np.ndarray) -> np.ndarray:
    """Which counts are odd, classes folded to 64 bits: one edit turns over two of them at most."""
    odd = (points.reshape(len(points), -1, 64).sum(axis=1) & 1).astype(np.uint8)
    return np.packbits(odd, axis=1).view(np.uint64)[:, 0]


class Tree:
    """A k-d tree over letter counts: inner nodes hold a letter and the count up to which a vector goes left."""

    def __init__(self, points: np.ndarray, leaf: float):
        self.nodes: list[tuple[int, int, int, int] | None] = []  # letter, count, left, right; a leaf has none
        self.at: list[np.ndarray] = []
        self._build(points, np.arange(len(points)), leaf)

    def _build(self, points: np.ndarray, at: np.ndarray, leaf: float) -> None:
        waiting = [(at, -1, 0)]
        while waiting:
            at, parent, side = waiting.pop()
            number = len(self.nodes)
            if parent >= 0:
                node = list(self.nodes[parent])
                node[2 + side] = number
                self.nodes[parent] = tuple(node)
            plane = self._plane(points[at]) if len(at) > leaf else None
            self.nodes.append(plane and (*plane, 0, 0))
            self.at.append(at if plane is None else at[:0])
            if plane:
                left = points[at, plane[0]] <= plane[1]
                waiting += [(at[left], number, 0), (at[~left], number, 1)]

    @staticmethod
    def _plane(points: np.ndarray) -> tuple[int, int] | None:
        """The letter and count that split best into halves; none if all are equal."""
        used = np.flatnonzero(points.any(axis=0))
        mine = np.ascontiguousarray(points[:, used])
        best, n = None, len(points)
        for count in {*range(USUAL), *(np.unique(mine.min(axis=0)).tolist())}:
            left = (mine <= count).sum(axis=0)
            off = np.where((left > 0) & (left < n), np.abs(2 * left - n), n)
            i = int(np.argmin(off))
            if off[i] < n and (best is None or off[i] < best[0]):
                best = (off[i], int(used[i]), count)
        return best and best[1:]

    def reach(self, points: np.ndarray, add: int, take: int) -> tuple[np.ndarray, np.ndarray]:
        """Which leaves hold vectors that ``add`` and ``take`` of at most one letter each make of a point: (point, leaf)."""
        n = len(points)
        waiting = [(0, np.arange(n), np.full(n, add), np.full(n, take))]
        out_point, out_leaf = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        while waiting:
            number, at, more, less = waiting.pop()
            if not len(at):
                continue
            node = self.nodes[number]
            if node is None:
                out_point.append(at)
                out_leaf.append(np.full(len(at), number))
                continue
            letter, count, left, right = node
            have = points[at, letter]
            down = have <= count
            up_too, down_too = down & (have + more > count), ~down & (have - less <= count)
            for child, stay, cross, paid in ((left, down, down_too, (0, 1)), (right, ~down, up_too, (1, 0))):
                both = [np.concatenate([x[stay], x[cross] - cost]) for x, cost in ((at, 0), (more, paid[0]), (less, paid[1]))]
                waiting.append((child, *both))
        return np.concatenate(out_point), np.concatenate(out_leaf)


def near_codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether row by row ``b`` is one edit away from ``a``; ``b`` is as long or one letter longer."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    front = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    back = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= a.shape[1]


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    length = np.array([len(w) for w in words], dtype=np.int64)
    for n in np.unique(length).tolist():
        yield n, np.flatnonzero(length == n)


def _route(trees):
    """Each word as a point of its tree (asks = 0) and as a question to all leaves that may hold near words (1)."""
    schema = pa.schema([("length", pa.int32()), ("leaf", pa.int32()), ("asks", pa.int32()), ("word", pa.string()), ("n", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            for length, at in _by_length(words):
                step = max(1, CHUNK // max(length, CLASSES))
                for part in (at[i : i + step] for i in range(0, len(at), step)):
                    points = vectors(letters([words[i] for i in part.tolist()]))
                    for to, add, take, asks in ((length, 0, 0, 0), (length, 1, 1, 1), (length + 1, 1, 0, 1)):
                        tree = trees.value.get(to)
                        which, leaf = tree.reach(points, add, take) if tree else (np.arange(len(part)), np.zeros(len(part), dtype=np.int64))
                        rows = part[which]
                        columns = [np.full(len(rows), to), leaf, np.full(len(rows), asks), [words[i] for i in rows.tolist()], counts[rows]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return scan, "length int, leaf int, asks int, word string, n long"


class _Held:
    """The words of one slice of a leaf, and the lower tree on them."""

    def __init__(self, words: list[str], counts: list[int]):
        self.words, self.counts = words, counts
        self.codes = letters(words)
        self.points = vectors(self.codes)
        self.odd = parities(self.points)
        self.tree = Tree(self.points, SMALL)

    def near(self, words: list[str]) -> Iterator[tuple[int, int]]:
        """Pairs (question, held word) one edit apart; of two words of one length the smaller asks."""
        for length, at in _by_length(words):
            same = length == self.codes.shape[1]
            step = max(1, CHUNK // max(length, CLASSES))
            for part in (at[i : i + step] for i in range(0, len(at), step)):
                codes = letters([words[i] for i in part.tolist()])
                points = vectors(codes)
                odd = parities(points)
                for a, b in self._boxed(points, odd, same, step):
                    right = near_codes(codes[a], self.codes[b])
                    for x, y in zip(part[a[right]].tolist(), b[right].tolist()):
                        if not same or words[x] < self.words[y]:
                            yield x, y

    def _boxed(self, points: np.ndarray, odd: np.ndarray, same: bool, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (question, held word) whose letter counts are as far apart as one edit makes them."""
        asker, leaf = self.tree.reach(points, 1, int(same))
        sizes = np.array([len(x) for x in self.tree.at], dtype=np.int64)
        first, order = np.cumsum(sizes) - sizes, np.concatenate(self.tree.at)
        many = np.cumsum(sizes[leaf])
        cuts = np.searchsorted(many, np.arange(0, int(many[-1]) if len(many) else 0, CHUNK), "right").tolist() + [len(leaf)]
        for low, high in zip(cuts, cuts[1:]):
            n = sizes[leaf[low:high]]
            a = np.repeat(asker[low:high], n)
            b = order[np.repeat(first[leaf[low:high]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            close = np.bitwise_count(odd[a] ^ self.odd[b]) <= 2
            a, b = a[close], b[close]
            for i in range(0, len(a), step):
                x, y = a[i : i + step], b[i : i + step]
                boxed = np.abs(points[x] - self.points[y]).sum(axis=1) == (2 if same else 1)
                yield x[boxed], y[boxed]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by slice, points before questions; points are held, questions stream by."""
    schema = pa.schema([("a", pa.string()), ("n_a", pa.int64()), ("b", pa.string()), ("n_b", pa.int64())])
    key, held, points, sizes = None, None, [], []
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("length", "leaf", "slice"))))
        asks, words, counts = (batch.column(c).to_pylist() for c in ("asks", "word", "n"))
        found, i = [], 0
        while i < len(keys):
            j = i
            while j < len(keys) and keys[j] == keys[i] and asks[j] == asks[i]:
                j += 1
            if keys[i] != key:
                key, held, points, sizes = keys[i], None, [], []
            if not asks[i]:
                points += words[i:j]
                sizes += counts[i:j]
            elif points:
                held = held or _Held(points, sizes)
                found += [(words[i + x], counts[i + x], held.words[y], held.counts[y]) for x, y in held.near(words[i:j])]
            i = j
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], f.type) for c, f in enumerate(schema)], schema=schema)


def _upper_trees(vocabulary: DataFrame, total: int, sample: int, leaf: int) -> dict[int, Tree]:
    """A tree for each length that the sample holds; as a rule a leaf has half of ``leaf`` words."""
    share = min(1.0, sample / max(total, 1))
    some = vocabulary.filter(F.length("word") <= LONGEST).filter(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < math.ceil(share * (1 << 30)))
    words = sorted(r["word"] for r in some.select("word").collect())
    trees = {}
    for length, at in _by_length(words):
        tree = Tree(vectors(letters([words[i] for i in at.tolist()])), max(1.0, leaf / 2 * share))
        tree.at = []
        trees[length] = tree
    return trees


def near_pairs(vocabulary: DataFrame, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """``vocabulary``: distinct words with their counts (word, n). Returns each pair one edit apart once: a, n_a, b, n_b."""
    trees = vocabulary.sparkSession.sparkContext.broadcast(_upper_trees(vocabulary, vocabulary.count(), sample, leaf))
    scan, schema = _route(trees)
    routed = materialize(vocabulary.select("word", "n").mapInArrow(scan, schema))
    full = routed.filter("asks = 0").groupBy("length", "leaf").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > leaf)
    full = full.select("length", "leaf", F.ceil(F.col("c") / leaf).cast("int").alias("slices"))
    routed = routed.join(full, ["length", "leaf"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    mine = F.array(F.pmod(F.xxhash64("word"), F.col("slices")).cast("int"))
    routed = routed.withColumn("slice", F.explode(F.when(F.col("asks") == 0, mine).otherwise(F.sequence(F.lit(0), F.col("slices") - 1))))
    dealt = routed.drop("slices").repartition("length", "leaf", "slice").sortWithinPartitions("length", "leaf", "slice", "asks")
    return dealt.mapInArrow(_search, "a string, n_a long, b string, n_b long")


def variants(vocabulary: DataFrame, ratio: int = RATIO, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """Words (word, n; distinct, n at least 1) with the number of near words, form, its count, and root."""
    pairs = materialize(near_pairs(vocabulary, sample, leaf))
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("m"))
    both = both.union(pairs.select("b", "n_b", "a", "n_a"))
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.first("n").alias("n_word"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("x")
    )
    good = -F.col("x.m") >= ratio * F.col("n_word")
    best = materialize(best.select("word", "n_near", F.when(good, F.col("x.near")).alias("form"), F.when(good, -F.col("x.m")).alias("form_n")))
    hops = best.filter("form IS NOT NULL").select("word", F.col("form").alias("root"), "form_n")
    most = hops.agg(F.max("form_n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(max(1.0, math.log(most, ratio)))) + 1):  # n grows ``ratio``-fold with each form
        on = hops.select(F.col("word").alias("root"), F.col("root").alias("further"))
        hops = materialize(hops.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    out = vocabulary.select("word", "n").join(best, "word", "left").join(hops.select("word", "root"), "word", "left")
    return out.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )


def word_counts(docs: DataFrame, word: Column, text: str = "text", letters_: str = "[A-Za-zÀ-ÿ]+", least: int = 6, often: int = 5) -> DataFrame:
    """Distinct words of at least ``least`` letters and ``often`` occurrences (word, n); written, as it is read often.

    Runs of letters are lowered (A-Z only) and named ``run``; ``word`` says what becomes of each.
    """
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    runs = docs.withColumn("run", F.explode(F.regexp_extract_all(F.translate(text, upper, lower), F.lit(letters_), F.lit(0))))
    words = runs.filter(F.length("run") >= least).select(word.alias("word")).filter(F.length("word") >= least)
    return materialize(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= often))


def misspelt() -> Column:
    """The query's spelling mistakes: one run in 199 loses a letter, by the checksum of its document's id and itself."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = F.pmod(h, F.length("run")).cast("int")
    without = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return F.when(h % 199 == 0, without).otherwise(F.col("run"))


def query(spark, sf_dir: str) -> DataFrame:
    """op11: words of ``documents`` with their near words, forms and roots."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return variants(word_counts(docs, misspelt()))


#: CRC-32 (reflected polynomial 0xEDB88320) of the UTF-8 bytes, in SQL; letters are below U+0100.
SQL = """
WITH RECURSIVE tbl AS (SELECT list_transform(range(256), lambda i: list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (SELECT run, k, [4294967295::UBIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::UBIGINT] ELSE [195::UBIGINT, (unicode(c) - 64)::UBIGINT] END)) AS b FROM runs),
crcs AS (SELECT run, k, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[1 + (xor(c, x) % 256)::INT])), 4294967295::UBIGINT) AS h FROM bytes, tbl),
words AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM crcs),
vocab AS (SELECT word, sum(k)::BIGINT AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
dels AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
pairs AS (SELECT a.word, a.n, b.word AS near, b.n AS m FROM dels a JOIN dels b ON a.i = b.i AND a.s = b.s AND a.word <> b.word
  UNION SELECT d.word, d.n, v.word, v.n FROM dels d JOIN vocab v ON d.s = v.word
  UNION SELECT v.word, v.n, d.word, d.n FROM dels d JOIN vocab v ON d.s = v.word),
best AS (SELECT word, any_value(n) AS n, count(*) AS n_near, max(m) AS m, arg_min(near, (-m, near)) AS near FROM pairs GROUP BY word),
forms AS (SELECT word, near AS form, m AS form_n FROM best WHERE m >= 5 * n),
chain AS (SELECT word, form AS root, 1 AS depth FROM forms UNION ALL SELECT c.word, f.form, depth + 1 FROM chain c JOIN forms f ON c.root = f.word),
roots AS (SELECT word, arg_max(root, depth) AS root FROM chain GROUP BY word)
SELECT v.word, f.form, coalesce(r.root, v.word) AS root, v.n, coalesce(b.n_near, 0)::BIGINT AS n_near, f.form_n::BIGINT AS form_n
FROM vocab v LEFT JOIN best b USING (word) LEFT JOIN forms f USING (word) LEFT JOIN roots r USING (word)
"""
