"""Exact order statistics and running sums over any number of rows.

A global sort order is cut into cells by a monotone function of the order
column (a time grid, or ``value_cell`` for doubles). Counts per cell form a
small table whose running sum gives each cell its offset; rows are only ever
ordered inside one cell. No step sends a whole key to one task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CELLS_PER_E_FOLD = 1000.0
_ZERO_OFFSET = 1_000_000


def value_cell(value: Column) -> Column:
    """Monotone BIGINT cell of a double, about 0.1 % wide; negative values mirror positive ones."""
    size = F.abs(value)
    level = F.least(F.ln(F.greatest(size, F.lit(1e-300))), F.lit(720.0))
    cell = F.floor(level * F.lit(_CELLS_PER_E_FOLD)) + F.lit(_ZERO_OFFSET)
    return F.when(value == 0, F.lit(0)).when(value > 0, cell).otherwise(-cell).cast("bigint")


def time_cell(time: Column, seconds: int) -> Column:
    """Epoch-aligned BIGINT cell of a timestamp."""
    return F.floor(F.unix_micros(time) / F.lit(seconds * 1_000_000)).cast("bigint")


def time_cells(time: Column, coarse_seconds: int = 3_600) -> list[Column]:
    """Cells for a timestamp order: a coarse grid and, inside it, steps of 10 ms, so busy periods split."""
    return [time_cell(time, coarse_seconds), F.floor(F.unix_micros(time) / F.lit(10_000)).cast("bigint")]


def running_sums(
    df: DataFrame,
    cells: Column | Sequence[Column],
    order_by: Sequence[Column],
    sums: Mapping[str, Column],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Add inclusive running sums of ``sums`` in the global order (``cells``, ``order_by``) per ``keys``.

    ``cells`` go from coarse to fine. Sums per finest cell form the only tables that are accumulated: the
    coarse cells of a key, then the finer cells inside each coarse one. Rows are ordered in one finest cell.
    """
    cells = [cells] if isinstance(cells, Column) else list(cells)
    names = [f"_c{i}" for i in range(len(cells))]
    rows = df.select(
        "*",
        *[cell.alias(n) for cell, n in zip(cells, names)],
        *[term.alias(f"_t_{name}") for name, term in sums.items()],
    )
    level = rows.groupBy(*keys, *names).agg(*[F.sum(f"_t_{n}").alias(f"_s_{n}") for n in sums])
    offsets = level
    for depth in range(len(names), 0, -1):
        inner, cell = [*keys, *names[: depth - 1]], names[depth - 1]
        before = Window.partitionBy(*inner).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
        here = level.select(
            *inner, cell, *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o{depth}_{n}") for n in sums]
        )
        offsets = here if depth == len(names) else offsets.join(here, [*inner, cell])
        if depth > 1:
            level = level.groupBy(*inner).agg(*[F.sum(f"_s_{n}").alias(f"_s_{n}") for n in sums])
    inside = (
        Window.partitionBy(*keys, *names).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )

    def total(name: str) -> Column:
        parts = [F.col(f"_o{d}_{name}") for d in range(1, len(names) + 1)]
        return reduce(add, parts) + F.sum(f"_t_{name}").over(inside)

    return rows.join(offsets, [*keys, *names]).select(*df.columns, *[total(n).alias(n) for n in sums])


def global_rank(
    df: DataFrame,
    cells: Column | Sequence[Column],
    order_by: Sequence[Column],
    name: str = "rank",
    keys: Sequence[str] = (),
) -> DataFrame:
    """1-based row number of each row in the global order, per ``keys``. ``order_by`` must be unique."""
    return running_sums(df, cells, order_by, {name: F.lit(1).cast("bigint")}, keys)


def values_at_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: Mapping[str, Callable[[Column], Column]],
    weight: str | None = None,
) -> DataFrame:
    """Per ``keys`` (non-null) the values at 0-based ranks of the sorted values, and their number ``_total``.

    ``ranks`` maps an output column to a function from the number of values to a rank.

    1. Count equal values: the shuffle key holds the value, so a hot key spreads over all tasks.
    2. Histogram of value cells per key: the running sum tells which cells hold the wanted ranks.
    3. Only those cells are ordered (distinct values, a spillable sort) to pick the wanted ones.

    Null and NaN values are ignored; a key without values gives no row.
    """
    keys = list(keys)
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    known = F.col("_cell").isNotNull()  # stated for both uses of ``cells``, so that they share one exchange
    for key in keys:
        known = known & F.col(key).isNotNull()
    cells = (
        df.select(*keys, F.col(value).cast("double").alias("_v"), *([weight] if weight else []))
        .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .groupBy(*keys, "_v")
        .agg(amount.cast("bigint").alias("_n"))
        .withColumn("_cell", value_cell(F.col("_v")))
        .where(known)
    )
    histogram = cells.groupBy(*keys, "_cell").agg(F.sum("_n").alias("_cell_n"))
    up_to = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def holds(rank: Column, low: Column, high: Column) -> Column:
        return (rank >= low) & (rank < high)

    wanted = {name: rank(F.col("_total")).cast("bigint") for name, rank in ranks.items()}
    cell_from, cell_to = F.col("_upto") - F.col("_cell_n"), F.col("_upto")
    picks = (
        histogram.select(
            "*",
            F.sum("_cell_n").over(up_to).alias("_upto"),
            F.sum("_cell_n").over(Window.partitionBy(*keys)).alias("_total"),
        )
        .where(reduce(or_, [holds(rank, cell_from, cell_to) for rank in wanted.values()]))
        .select(*keys, "_cell", cell_from.alias("_from"), "_total")
    )
    inside = Window.partitionBy(*keys, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = cells.join(picks, [*keys, "_cell"]).select(
        *keys, "_v", "_n", "_total", (F.col("_from") + F.sum("_n").over(inside)).alias("_end")
    )
    return hits.groupBy(*keys).agg(
        F.max("_total").alias("_total"),
        *[
            F.max(F.when(holds(rank, F.col("_end") - F.col("_n"), F.col("_end")), F.col("_v"))).alias(name)
            for name, rank in wanted.items()
        ],
    )


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    weight: str | None = None,
) -> DataFrame:
    """Linear-interpolated percentiles per ``keys``, one output column per entry (see ``values_at_ranks``)."""
    bounds: dict[str, Callable[[Column], Column]] = {}
    for i, p in enumerate(quantiles.values()):
        bounds[f"_low{i}"] = lambda n, p=p: F.floor((n - 1) * F.lit(float(p)))
        bounds[f"_high{i}"] = lambda n, p=p: F.ceil((n - 1) * F.lit(float(p)))
    found = values_at_ranks(df, keys, value, bounds, weight)
    interpolated = [
        F.expr(
            f"_low{i} + (_high{i} - _low{i}) * ((_total - 1) * {float(p)!r}D - floor((_total - 1) * {float(p)!r}D))"
        ).alias(name)
        for i, (name, p) in enumerate(quantiles.items())
    ]
    return found.select(*keys, *interpolated)
