"""Chained times: a key's first instant, then again and again the first one at least a wait after the one before.

Cooldowns (an alert counts only some time after the last one that counted) and checks driven by events are such
chains. Each link depends on the one before, so neither ``lag`` nor a fixed grid gives them; as joins they take

1. *successors*: every instant's next link, by a search on a grid of cells one wait wide with 64 finer cells in each;
2. *doubling*: a block holds 2^k cells that hold instants, and an instant at which a chain can enter it knows where that chain leaves. A
   chain has at most one link in a cell and enters a block in its first cell or, if there is nothing left in that, at
   the first instant after it, so blocks of twice the size keep half the instants and all tables together two rows an
   instant;
3. *marking*: from the first instant on, blocks are entered from large to small.

No key is held by one task: rows meet by (key, instant) or lie in one fine cell of a key. Only windows over a key's
cells of one wait are as long as the clock allows. Every table is written once, lineage ends there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.session import discard, materialize

_FINE = 64


def _successors(moments: DataFrame, keys: list[str], origin: int) -> DataFrame:
    """Each instant with its cell, the cell of the instant before it, the next link and its cell: keys, _us, _cell,
    _before, _next, _there. Cells are numbered from 0 over those of the key that hold instants."""
    events = moments.select(*keys, "_wait", "_us", F.col("_us").alias("_at"), F.lit(True).alias("_is"))
    probes = moments.select(*keys, "_wait", "_us", (F.col("_us") + F.col("_wait")).alias("_at"), F.lit(False).alias("_is"))
    rows = events.unionByName(probes).withColumns(
        {"_cell": F.expr(f"(_at - {origin}L) DIV _wait"), "_fine": F.expr(f"((_at - {origin}L) * {_FINE}L) DIV _wait")}
    )
    event = F.when(F.col("_is"), F.col("_at"))
    fine = [*keys, "_cell", "_fine"]
    down = Window.partitionBy(*fine).orderBy(F.desc("_at"), F.desc("_is")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    up = Window.partitionBy(*fine).orderBy("_at", "_is").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_next": F.min(event).over(down), "_last": F.max(event).over(up)})

    level = rows.groupBy(*fine).agg(F.min(event).alias("_lo"), F.max(event).alias("_hi"))
    whole = level.groupBy(*keys, "_cell").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))

    def around(table: DataFrame, inner: list[str], cell: str, name: str, *more: Column) -> DataFrame:
        later = Window.partitionBy(*inner).orderBy(F.desc(cell)).rowsBetween(Window.unboundedPreceding, -1)
        sooner = Window.partitionBy(*inner).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
        return table.select(
            *inner, cell, F.min("_lo").over(later).alias(f"_next_{name}"), F.max("_hi").over(sooner).alias(f"_last_{name}"), *more
        )

    number = F.count("_lo").over(Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cells = around(whole, keys, "_cell", "cell", number.alias("_number"))  # cells with instants, up to and with this one
    rows = rows.join(around(level, [*keys, "_cell"], "_fine", "fine").join(cells, [*keys, "_cell"]), fine)
    here_next, here_last = F.coalesce("_next", "_next_fine"), F.coalesce("_last", "_last_fine")
    rows = rows.select(
        *keys, "_us", "_is",
        F.when(F.col("_is"), F.col("_number") - 1).alias("_cell"),
        F.when(F.col("_is"), F.when(here_last.isNotNull(), F.col("_number") - 1).otherwise(F.col("_number") - 2)).alias("_before"),
        F.when(~F.col("_is"), F.coalesce(here_next, "_next_cell")).alias("_next"),
        F.when(~F.col("_is"), F.when(here_next.isNotNull(), F.col("_number") - 1).otherwise(F.col("_number"))).alias("_there"),
    )
    return rows.groupBy(*keys, "_us").agg(*[F.max(c).alias(c) for c in ("_cell", "_before", "_next", "_there")])


def chained(moments: DataFrame, keys: Sequence[str], time: str, wait: Column | int) -> DataFrame:
    """The chain of every key: keys, ``time`` (micros).

    ``time`` is a BIGINT of micros, ``wait`` micros, positive and the same for all rows of a key. Repeated instants
    count once; rows with a null key or time take no part.
    """
    keys = list(keys)
    rows = moments.select(*keys, F.col(time).cast("bigint").alias("_us"), (F.lit(wait) if isinstance(wait, int) else wait).cast("bigint").alias("_wait"))
    rows = materialize(rows.dropna().dropDuplicates([*keys, "_us"]))
    low = rows.agg(F.min("_us")).first()[0]
    if low is None:
        return rows.select(*keys, F.col("_us").alias(time))
    tables = [materialize(_successors(rows, keys, low))]
    discard(rows)
    levels = tables[0].agg(F.max("_cell")).first()[0].bit_length()
    begin = lambda c, size: F.col(c) - F.pmod(F.col(c), F.lit(size))  # noqa: E731  the first cell of a block
    same = lambda size: begin("_there", size) == begin("_cell", size)
    for k in range(1, levels + 1):
        size = 1 << k
        below = tables[-1]
        further = below.select(*keys, F.col("_us").alias("_next"), F.col("_next").alias("_next2"), F.col("_there").alias("_there2"))
        enters = below.filter(F.col("_before") <= begin("_cell", size)).join(further, [*keys, "_next"], "left")
        enters = enters.withColumn("_in", same(size))
        out = enters.withColumns({c: F.when(F.col("_in"), F.col(f"{c}2")).otherwise(F.col(c)) for c in ("_next", "_there")})
        tables.append(materialize(out.select(*below.columns)))
    chain = tables[0].groupBy(*keys).agg(F.min("_us").alias("_us"))
    for k in range(levels - 1, -1, -1):
        inside = tables[k].select(*keys, "_us", F.when(same(2 << k), F.col("_next")).alias("_next"))
        both = F.explode(F.array_compact(F.array("_us", "_next")))
        chain = chain.join(inside, [*keys, "_us"]).select(*keys, both.alias("_us"))
    out = materialize(chain.withColumnRenamed("_us", time))
    discard(*tables)
    return out
