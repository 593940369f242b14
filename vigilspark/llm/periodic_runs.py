"""Periodic runs of words: block convolution at dyadic scales, and extension of the distances it finds.

A run is a stretch of consecutive words with smallest period q, at least ``least`` words and two periods long, that no
neighbouring word extends. Scale B answers for the periods 2 B - 1 to 4 B - 2 (the lowest, B = 2, for 1 to 6): of a run
with such a period, the part that has its repetition behind it holds a whole block of B words that begins at a multiple
of B. For each block the sums of squared differences with every place of the window after it come from an exact integer
number-theoretic transform: words are folded to numbers so small that no sum reaches the prime, hence a sum is zero only
if all folded words agree. Zero sums are seeds; they are compared word by word (two words can be folded to one number)
and their distance is extended to both sides. Shorter periods come first, so a stretch whose smallest period is a
proper divisor of the distance lies in a run that is known already and is left out.

Two tests save transforms and lose nothing: a block with a word that doesn't come again as soon as the scale's longest
distance has no zero; and within a run of period q <= B, a block can only match at multiples of q.

Texts are worked on in groups of about half a megabyte; one longer text is a group of its own and takes memory in
proportion to its length. No rows are exchanged between tasks.

A null or empty text has no words and no runs. Every row is a document of its own, whatever its id. Other columns are
ignored. A text can have 2**27 words.
"""

from __future__ import annotations

import bisect
import collections
import itertools
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.llm.words import grouped

LEAST = 12
#: Modulus of the transform, 15 * 2**27 + 1, and a generator of its units.
PRIME, GENERATOR = 15 * (1 << 27) + 1, 31
#: Elements that are transformed at once.
CHUNK = 1 << 19
_P = np.uint64(PRIME)
_ROOTS: dict[tuple[int, bool], np.ndarray] = {}


def _roots(n: int, inverse: bool) -> np.ndarray:
    """The first half of the powers of a root of order ``n``."""
    if (n, inverse) not in _ROOTS:
        root = pow(GENERATOR, (PRIME - 1) // n, PRIME)
        root = pow(root, -1, PRIME) if inverse else root
        powers = np.ones(1, dtype=np.uint64)
        while len(powers) < n // 2:
            powers = np.concatenate([powers, powers * np.uint64(pow(root, len(powers), PRIME)) % _P])
        _ROOTS[n, inverse] = powers[:, None]
    return _ROOTS[n, inverse]


def _reduced(a: np.ndarray) -> np.ndarray:
    """Numbers below two primes to below one; what is too small wraps round and is larger."""
    return np.minimum(a, a - _P)


def transform(a: np.ndarray) -> np.ndarray:
    """Transform of every column of ``a`` (a power of two of rows), in bit-reversed order."""
    n = size = len(a)
    while n > 1:
        v = a.reshape(size // n, 2, n // 2, -1)
        x, y = v[:, 0], v[:, 1]
        out = np.empty_like(v)
        out[:, 0] = _reduced(x + y)
        out[:, 1] = (x + (_P - y)) * _roots(n, False) % _P
        a, n = out, n // 2
    return a.reshape(size, -1)


def inverse(a: np.ndarray) -> np.ndarray:
    """What ``transform`` was applied to."""
    size, n = len(a), 2
    while n <= size:
        v = a.reshape(size // n, 2, n // 2, -1)
        x, y = v[:, 0], v[:, 1] * _roots(n, True) % _P
        out = np.empty_like(v)
        out[:, 0] = _reduced(x + y)
        out[:, 1] = _reduced(x + (_P - y))
        a, n = out, n * 2
    return a.reshape(size, -1) * np.uint64(pow(size, -1, PRIME)) % _P


def mismatches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sums of squared differences of each column of ``blocks`` with all places of its column of ``windows``.

    Exact if they stay below PRIME.
    """
    width, length = len(blocks), len(windows)
    places = length - width + 1
    size = 1 << (length - 1).bit_length()
    a, b = (np.zeros((size, blocks.shape[1]), dtype=np.uint64) for _ in range(2))
    a[0], a[size - width + 1 :] = blocks[0], blocks[:0:-1]
    b[:length] = windows
    product = inverse(transform(a) * transform(b) % _P)[:places]
    squares = np.zeros((length + 1, blocks.shape[1]), dtype=np.uint64)
    np.cumsum(windows * windows, axis=0, out=squares[1:])
    total = (blocks * blocks).sum(axis=0) + squares[width:] - squares[:places]
    return (total + np.uint64(2) * (_P - product)) % _P


def scales(longest: int) -> Iterator[tuple[int, int, int]]:
    """Block width, shortest and longest distance of every scale that a text of ``longest`` words needs."""
    width, low, high = 2, 1, 6
    while 2 * low <= longest:
        yield width, low, high
        width *= 2
        low, high = 2 * width - 1, 4 * width - 2


class _Runs:
    """Runs of a group of texts, by text and period."""

    def __init__(self, words: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int):
        self.words, self.begin, self.end, self.least = words, begin, end, least
        self.found: list[tuple[int, int, int, int]] = []  # text, begin, end, period
        self._by_period: dict[int, dict[int, tuple[list[int], list[int]]]] = collections.defaultdict(dict)

    def known(self, text: int, begin: int, end: int, distance: int) -> bool:
        """Whether a run with a period that divides ``distance`` holds the stretch."""
        for period, (begins, ends) in self._by_period[text].items():
            if distance % period == 0:
                i = bisect.bisect_right(begins, begin) - 1
                if i >= 0 and ends[i] >= end:
                    return True
        return False

    def extend(self, text: int, at: int, distance: int) -> None:
        """Take up the run around a block at ``at`` that comes again ``distance`` words later."""
        words, first, last = self.words, int(self.begin[text]), int(self.end[text]) - distance
        right, step = at, 64
        while right < last:
            step = min(step, last - right)
            apart = np.flatnonzero(words[right : right + step] != words[right + distance : right + distance + step])
            if len(apart):
                right += int(apart[0])
                break
            right, step = right + step, step * 2
        left, step = at, 64
        while left > first:
            step = min(step, left - first)
            apart = np.flatnonzero(words[left - step : left] != words[left - step + distance : left + distance])
            if len(apart):
                left += int(apart[-1]) + 1 - step
                break
            left, step = left - step, step * 2
        end = right + distance
        if end - left >= max(self.least, 2 * distance) and not self.known(text, left, end, distance):
            self.found.append((text, left, end, distance))
            begins, ends = self._by_period[text].setdefault(distance, ([], []))
            i = bisect.bisect(begins, left)
            begins.insert(i, left)
            ends.insert(i, end)

    def reach(self, width: int) -> np.ndarray:
        """For every word, how far a run with a period of at most ``width`` goes that holds it."""
        out = np.zeros(len(self.words) + 1, dtype=np.int64)
        some = np.array([(b, e) for _, b, e, q in self.found if q <= width], dtype=np.int64).reshape(-1, 2)
        np.maximum.at(out, some[:, 0], some[:, 1])
        return np.maximum.accumulate(out)


def _seeds(words: np.ndarray, at: np.ndarray, end: np.ndarray, width: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks (by number) and distances at which a block comes again."""
    fold = math.isqrt((PRIME - 1) // width)
    length = high - low + width
    folded = (words % fold).astype(np.uint64)
    block, distance = [], []
    columns = max(1, CHUNK // length)
    for first in range(0, len(at), columns):
        here, until = at[first : first + columns], end[first : first + columns]
        places = here + low + np.arange(length)[:, None]
        inside = places < until
        windows = np.where(inside, folded[np.minimum(places, len(words) - 1)], np.uint64(fold))
        d, b = np.nonzero(mismatches(folded[here + np.arange(width)[:, None]], windows) == 0)
        block.append(b + first)
        distance.append(d + low)
    block, distance = np.concatenate(block), np.concatenate(distance)
    same = np.ones(len(block), dtype=bool)
    for first in range(0, len(block), max(1, CHUNK // width)):
        part = slice(first, first + max(1, CHUNK // width))
        places = at[block[part]] + np.arange(width)[:, None]
        same[part] = (words[places] == words[places + distance[part]]).all(axis=0)
    return block[same], distance[same]


def find(words: np.ndarray, counts: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int, int]]:
    """Runs (text, first word, word after the last, period) of texts that stand one after the other in ``words``."""
    end = np.cumsum(counts)
    begin = end - counts
    runs = _Runs(words, begin, end, least)
    if not len(words):
        return []
    text_of = np.repeat(np.arange(len(counts)), counts)
    key = text_of * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    again = np.full(len(words), np.iinfo(np.int64).max)
    twice = key[order[1:]] == key[order[:-1]]
    again[order[:-1][twice]] = (order[1:] - order[:-1])[twice]
    for width, low, high in scales(int(counts.max())):
        many = np.maximum((counts - low - width) // width + 1, 0)
        text = np.repeat(np.arange(len(counts)), many)
        at = begin[text] + (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * width
        late = np.concatenate([[0], np.cumsum(again > high)])
        open_ = (late[at + width] == late[at]) & (runs.reach(width)[at] < np.minimum(at + high + width, end[text]))
        text, at = text[open_], at[open_]
        if not len(at):
            continue
        block, distance = _seeds(words, at, end[text], width, low, high)
        by = np.lexsort((at[block], distance))
        block, distance = block[by], distance[by]
        place = at[block]
        new = np.ones(len(block), dtype=bool)  # blocks side by side at one distance are one stretch
        new[1:] = (distance[1:] != distance[:-1]) | (place[1:] != place[:-1] + width) | (text[block[1:]] != text[block[:-1]])
        for t, p, d in zip(text[block[new]].tolist(), place[new].tolist(), distance[new].tolist()):
            if not runs.known(t, p, p + width + d, d):
                runs.extend(t, p, d)
    return [(t, b - int(begin[t]), e - int(begin[t]), q) for t, b, e, q in sorted(runs.found)]


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    for begin, end, period in runs:
        drop[begin + period] += 1
        drop[end] -= 1
    return b" ".join(itertools.compress(words, (np.cumsum(drop[:-1]) == 0).tolist()))


def _scan(least: int, rewrite: Callable[[int | None, int], np.ndarray | None] | None):
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.string())])

    def group(ids: list[int | None], texts: list[str | None]) -> pa.RecordBatch:
        numbers = collections.defaultdict(itertools.count().__next__)
        words, codes = [], []
        for doc, text in zip(ids, texts):
            mine = text.encode("utf-8", "surrogatepass").split() if text else []
            places = rewrite(doc, len(mine)) if rewrite else None
            mine = mine if places is None else [mine[i] for i in places.tolist()]
            words.append(mine)
            codes.append(np.fromiter(map(numbers.__getitem__, mine), np.int64, len(mine)))
        runs: list[list] = [[] for _ in words]
        for text, *one in find(np.concatenate(codes), np.array([len(w) for w in words], dtype=np.int64), least):
            runs[text].append(one)
        told = [sorted((b, e - b, q) for b, e, q in r) for r in runs]
        columns = {
            "doc": ids,
            "n_words": [len(w) for w in words],
            "runs": [[dict(zip(("start", "length", "period"), x)) for x in r] for r in told],
            "collapsed": [_collapsed(w, r).decode("utf-8", "surrogatepass") for w, r in zip(words, runs)],
        }
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc").to_pylist()
            for first, texts in grouped(batch.column("text").to_pylist()):
                yield group(ids[first : first + len(texts)], texts)

    return scan


def detect(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    least: int = LEAST,
    rewrite: Callable[[int | None, int], np.ndarray | None] | None = None,
) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period, in this order), collapsed (the words that no
    run holds after its first period).

    ``rewrite`` may give, from a document's id and number of words, the places of the words to look at instead.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    schema = "doc long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return rows.mapInArrow(_scan(least, rewrite), schema).withColumnRenamed("doc", doc_id)


def planted(doc: int | None, n: int) -> np.ndarray | None:
    """The repetition that the query plants in one document of ten; a document without an id has none."""
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def query(spark, sf_dir: str) -> DataFrame:
    """op12: runs of ``documents`` with planted repetitions, the longest run, and digests of all runs and kept words."""
    out = detect(spark.read.parquet(f"{sf_dir}/documents.parquet"), rewrite=planted)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    told = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return out.withColumn("x", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("x.start")).alias("start"),
        F.col("x.length").alias("length"),
        (-F.col("x.period")).alias("period"),
        F.floor(1000 * F.col("x.length") / -F.col("x.period")).alias("exponent_milli"),
        F.sha2(told.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
