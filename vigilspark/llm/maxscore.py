"""Exact top-k inner products by MaxScore over shards of vectors.

Dimensions are the terms of a query, and a shard's column for a dimension is its posting list. In a shard a term adds
between its least and its greatest product with the column; with the least moved into a common base, every term adds
from 0 to its bound. Terms are sorted by bound. The leading ones are essential: their lists are traversed for all
vectors, and the best partial sums are completed, which gives the score to beat. The other terms are probed in order,
only for vectors whose partial sum and remaining bounds still reach that score. Nothing that could tie is dropped, so
the k best of a shard are exact, and the best of all shards' lists are the result.

Candidates fall into shards of SHARD rows by position, queries into blocks of QUERIES; a task takes one block against
one shard, so its memory is bounded at any size, and shards and blocks are only replicated against each other as
rows. A query's own row is not its candidate: both tables carry a ``row`` number, and the candidate with the query's is
left out. Queries with one id are separate queries.

Null vectors and vectors with null or non-finite components take no part; shorter vectors count as filled with zeros.
Null ids take no part. Repeated rows are separate candidates; ties go to the smaller id. Where sums may pass 2**53, bounds
are widened by what rounding can take, and what is left is scored in whole numbers; a score beyond a long is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.session import materialize

SHARD = 2048
QUERIES = 4096
#: Terms added at a time; the first step is the least essential set.
STEP = 8
#: Whole numbers below it are exact as doubles, and so are their sums.
EXACT = 2.0**53
#: More than all roundings of a sum take, by its number of terms and the sum of their sizes.
ROUNDING = 2.0**-48


def quantised(vector: Column) -> Column:
    """floor(256 x) of every component, a whole double; null unless all components are finite."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def floor(x: Column) -> Column:
        scaled = 256 * x.cast("double")
        return F.when(F.abs(scaled) < EXACT, F.floor(scaled).cast("double")).otherwise(scaled)  # larger ones are whole

    return F.when(whole, F.transform(vector, floor))


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    rows = lists.combine_chunks()
    sizes = np.diff(rows.offsets.to_numpy())
    out = np.zeros((len(rows), width))
    out[np.repeat(np.arange(len(rows)), sizes), np.concatenate([np.arange(n) for n in sizes]).astype(np.int64)] = rows.flatten().to_numpy()
    return out


def top_k(ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, query: np.ndarray, own: int, k: int, low: np.ndarray, high: np.ndarray):
    """Ids and scores of the k best rows of ``vectors`` for one query, best first; the row numbered ``own`` is left out."""
    a, b = query * low, query * high
    bound = np.abs(a - b)
    terms = np.argsort(-bound, kind="stable")
    left = np.append(np.cumsum(bound[terms][::-1])[::-1], 0.0)  # what the terms from here on can add
    base = np.minimum(a, b)[terms]
    rest = np.append(np.cumsum(base[::-1])[::-1], 0.0)
    largest = np.abs(query) @ np.maximum(np.abs(low), np.abs(high))
    slack = 0.0 if largest < EXACT else largest * len(query) * ROUNDING
    alive = np.flatnonzero(rows != own)
    partial = np.zeros(len(alive))
    beat = -np.inf
    at = 0
    while at < len(terms) and len(alive):
        now = terms[at : at + STEP]
        partial = partial + vectors[alive[:, None], now] @ query[now] if len(alive) < len(ids) // 2 else partial + (vectors[:, now] @ query[now])[alive]
        at += len(now)
        if beat == -np.inf and len(alive) > k:
            best = alive[np.argpartition(-partial, k - 1)[:k]]
            beat = (vectors[best] @ query).min()  # k candidates reach it
        keep = partial + rest[at] + left[at] + 2 * slack >= beat
        alive, partial = alive[keep], partial[keep]
    if slack:
        return _whole_scores(ids[alive], vectors[alive], query, k)
    order = np.lexsort((ids[alive], -partial))[:k]
    return ids[alive][order], partial[order].astype(np.int64)


def _whole_scores(ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, k: int):
    """The k best of a few rows whose sums doubles don't hold."""
    sums, off = vectors @ query, np.abs(vectors) @ np.abs(query) * len(query) * ROUNDING
    if len(ids) > k:
        near = sums + off >= np.partition(sums - off, -k)[-k]
        ids, vectors = ids[near], vectors[near]
    whole = list(map(int, query))
    scores = [sum(int(x) * y for x, y in zip(v, whole)) for v in vectors.tolist()]
    order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
    return ids[order], np.array([scores[i] for i in order], dtype=np.int64)


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with a ``row`` number, written once so that it never changes."""
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()))


def search(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``rows`` and ``queries``: vec_id, vector (array of whole numbers that doubles hold), row. Returns query_id, rank, vec_id, score."""
    usable = "vec_id IS NOT NULL AND vector IS NOT NULL"
    rows, queries = rows.filter(usable), queries.filter(usable)
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    n_queries = queries.count()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-n_queries // QUERIES))
    width = max(width or 1, 1)

    def dealt(df: DataFrame, own: str, of: int, other: str, others: int) -> DataFrame:
        # rows of a file go round the shards; int on both sides, since tasks are picked by a hash that differs for a long
        at = ((F.monotonically_increasing_id() + F.spark_partition_id() * 7919) % of).cast("int")
        return df.select("vec_id", "vector", "row", at.alias(own)).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            ids, own, vectors = left.column("vec_id").to_numpy(), left.column("row").to_numpy(), _matrix(left.column("vector"), width)
            low, high = vectors.min(axis=0), vectors.max(axis=0)
            asked = zip(right.column("vec_id").to_numpy(), right.column("row").to_numpy(), _matrix(right.column("vector"), width))
            for query_id, row, query in asked:
                best, scores = top_k(ids, own, vectors, query, row, k, low, high)
                found.append((np.full(len(best), query_id), np.full(len(best), row), best, scores))
        columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=np.int64) for i in range(4)]
        return pa.table(dict(zip(("query_id", "row", "vec_id", "score"), columns)))

    a = dealt(rows, "shard", shards, "block", blocks).groupBy("shard", "block")
    b = dealt(queries, "block", blocks, "shard", shards).groupBy("shard", "block")
    lists = a.cogroup(b).applyInArrow(score, "query_id long, row long, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")  # k rows from each shard
    return lists.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the five best of ``embeddings`` for every vec_id divisible by 50."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", quantised(F.col("embedding")).alias("vector"))
    rows = numbered(rows)
    return search(rows, rows.filter("vec_id % 50 = 0"), 5)


SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND vec_id IS NOT NULL
), s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
