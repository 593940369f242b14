"""Interval joins as equi-joins on a time grid or on dyadic nodes, so neither side has to be broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.plans.ordering import time_cell


def _nodes(first: Column, last: Column, levels: int) -> Column:
    """Dyadic nodes that make up the cells ``first`` to ``last`` (not included): at most two a level."""

    def at(k: int) -> Column:
        low, high = F.ceil(first / (1 << k)).cast("bigint"), F.floor(last / (1 << k)).cast("bigint")
        node = lambda i: F.struct(F.lit(k).alias("_level"), i.alias("_node"))
        if k == levels:
            return F.when(low < high, F.transform(F.sequence(low, high - 1), node)).otherwise(F.array().cast("array<struct<_level:int,_node:bigint>>"))
        left = F.when((low < high) & (F.pmod(low, F.lit(2)) == 1), node(low))
        right = F.when((low < high) & (F.pmod(high, F.lit(2)) == 1), node(high - 1))
        return F.array_compact(F.array(left, right))

    return F.array_distinct(F.flatten(F.array(*[at(k) for k in range(levels + 1)])))


def points_of_spans(
    points: DataFrame, spans: DataFrame, point: str, span: tuple[str, str], unit_seconds: int, keys: Sequence[str] = (), levels: int = 12
) -> DataFrame:
    """Candidates for points within half-open spans, each pair once: spans are cut into dyadic nodes (O(log length)
    rows each) and a point looks up its node on every level, so the pairs are the true ones but for those of a span's
    two end cells (``unit_seconds`` wide). Spans over ``unit_seconds * 2 ** levels`` take a row per such stretch.

    Equal column names other than ``keys`` must not occur in both tables.
    """
    start, end = span
    first, last = time_cell(F.col(start), unit_seconds), time_cell(F.col(end), unit_seconds) + 1
    inside = spans.where(F.col(start) <= F.col(end)).select("*", F.explode(_nodes(first, last, levels)).alias("_n"))
    inside = inside.select("*", "_n.*").drop("_n")
    cell = time_cell(F.col(point), unit_seconds)
    places = [F.struct(F.lit(k).alias("_level"), F.floor(cell / (1 << k)).cast("bigint").alias("_node")) for k in range(levels + 1)]
    asked = points.select("*", F.explode(F.array(*places)).alias("_n")).select("*", "_n.*").drop("_n")
    return asked.join(inside, [*keys, "_level", "_node"]).drop("_level", "_node")


def overlap_candidates(
    left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], unit_seconds: int, keys: Sequence[str] = ()
) -> DataFrame:
    """Pairs in which one span may begin within the other, each pair once."""
    (ls, _), (rs, _) = left_span, right_span
    begins = points_of_spans(right, left, rs, left_span, unit_seconds, keys).where(F.col(rs) >= F.col(ls))
    begun = points_of_spans(left, right, ls, right_span, unit_seconds, keys).where(F.col(ls) > F.col(rs))
    return begins.unionByName(begun)


def overlap_pairs(
    left: DataFrame,
    right: DataFrame,
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    unit_seconds: int,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Inner pairs whose half-open spans overlap (both bounds strict), each pair once.

    Of two spans that overlap one begins within the other, so this is two joins of points and spans. Choose
    ``unit_seconds`` near the shorter of the usual span lengths.
    """
    (ls, le), (rs, re) = left_span, right_span
    pairs = overlap_candidates(left.where(F.col(ls) <= F.col(le)), right.where(F.col(rs) <= F.col(re)), left_span, right_span, unit_seconds, keys)
    return pairs.where((F.col(ls) < F.col(re)) & (F.col(le) > F.col(rs)))


def points_in_spans(
    points: DataFrame,
    spans: DataFrame,
    point: str,
    span: tuple[str, str],
    cell_seconds: int,
    keys: Sequence[str] = (),
    how: str = "left",
    condition: Column | None = None,
) -> DataFrame:
    """Points joined to the spans that hold them (bounds inclusive). A point has one cell, so
    ``how='left'`` keeps unmatched points without a second join and ``'left_anti'`` keeps only those."""
    start, end = span
    grid = spans.withColumn(
        "_cell",
        F.explode(F.sequence(time_cell(F.col(start), cell_seconds), time_cell(F.col(end), cell_seconds))),
    )
    p, s = points.withColumn("_cell", time_cell(F.col(point), cell_seconds)).alias("p"), grid.alias("s")
    on = (F.col("p._cell") == F.col("s._cell")) & F.col(f"p.{point}").between(F.col(f"s.{start}"), F.col(f"s.{end}"))
    for key in keys:
        on = on & (F.col(f"p.{key}") == F.col(f"s.{key}"))
    if condition is not None:
        on = on & condition
    extra = [] if how in ("left_anti", "left_semi") else [F.col(f"s.{c}") for c in spans.columns if c not in points.columns]
    kept = [F.col(f"p.{c}") for c in points.columns]
    return p.join(s, on, how).select(*kept, *extra)
