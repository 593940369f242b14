"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

Domains hold languages, languages hold sources. The token budget is propagated from the root: each node splits
its budget among its children by their weights. A child's capacity is what its leaves hold times the number of
epochs allowed; where its share is larger, the shortage goes to its siblings, again by weight. What all siblings
together can't take was never given to their parent, because a parent's capacity is the sum of theirs: so shortages
are settled among siblings first and among ancestors' siblings next. Each leaf takes its budget from seeded
epochs: all rows as often as whole epochs fit, then the longest prefix of the next epoch's shuffled rows that fits.

Shares are exact: a node sorted before others by capacity / weight is full when capacity * (weights left) <=
(budget left) * weight; the others split the rest, rounded down to whole tokens, so fewer tokens than there are
siblings stay unassigned at a node. Products need budget * (sum of weights) < 2**63.

The tree is an aggregate, as small as the number of leaves; only sums by leaf and cell (``ranks``) meet the rows,
so a leaf with a third of all rows is spread over thousands of cells.

Nulls: a null domain, language or source is a node of its own; a null or empty text has no tokens, fits in any
prefix and is repeated with its leaf's whole epochs. Repeated rows are separate rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.llm import ranks
from vigilspark.session import materialize

LEVELS = ["domain", "lang", "source"]

#: Production weights: by domain, by language, by source; any other name weighs 1.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 2}}


def domain_of(source: Column) -> Column:
    """Domain of a source where the table has no such column: one of four, by checksum."""
    return F.concat(F.lit("d"), (F.crc32(source.cast("binary")) % 4).cast("string"))


def token_estimate(text: Column) -> Column:
    """Tokens of a text before it is encoded: a quarter of its bytes, rounded up."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("long")


def budgets(leaves: DataFrame, share: tuple[int, int], epochs: int, weights: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """``leaves``: domain, lang, source, tokens (one row each). Adds ``budget``.

    The root's budget is ``share[0] / share[1]`` of all tokens, at most what all epochs hold.
    """
    given = leaves.withColumn("capacity", F.col("tokens") * epochs)
    nodes = [given]
    for depth in (2, 1):
        nodes.insert(0, nodes[0].groupBy(*LEVELS[:depth]).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens")))
    root = nodes[0].agg(F.sum("tokens").alias("t"), F.sum("capacity").alias("c"))
    budget = root.select(F.least(F.expr(f"t * {share[0]} div {share[1]}"), F.col("c")).alias("parent"))
    level = nodes[0].withColumn("parent", F.coalesce(budget.scalar(), F.lit(0)))
    for depth, table in enumerate(nodes):
        keys = LEVELS[: depth + 1]
        if depth:
            up = level.select(*[F.col(k).alias(f"_{k}") for k in keys[:-1]], F.col("budget").alias("parent"))
            level = table.join(up, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys[:-1]]).drop(*[f"_{k}" for k in keys[:-1]])
        level = level.withColumn("w", _weight(keys[-1], weights))
        siblings = Window.partitionBy(*keys[:-1]) if depth else Window.partitionBy(F.lit(0))
        order = siblings.orderBy((F.col("capacity") / F.col("w")).asc(), F.col(keys[-1]).asc_nulls_first())
        earlier = order.rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumns(
            {
                "left": F.col("parent") - F.coalesce(F.sum("capacity").over(earlier), F.lit(0)),
                "others": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)),
            }
        )
        level = level.withColumn("full", F.col("capacity") * F.col("others") <= F.col("left") * F.col("w"))
        level = level.withColumns(
            {
                "rest": F.col("parent") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(siblings), F.lit(0)),
                "open": F.sum(F.when(~F.col("full"), F.col("w"))).over(siblings),
            }
        )
        level = level.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(F.expr("rest * w div open")))
        level = level.select(*keys, "capacity", "tokens", "budget")
    return level


def mix(
    docs: DataFrame,
    share: tuple[int, int] = (4, 5),
    epochs: int = 2,
    seed: int = 11,
    weights: Mapping[str, Mapping[str, int]] = WEIGHTS,
    domain: Column | None = None,
    tokens: Column | None = None,
) -> DataFrame:
    """``docs`` with ``domain``, ``tokens``, ``budget`` (of the leaf) and ``copies``, how often each row is taken."""
    names = {"_domain": domain_of(F.col("source")) if domain is None else domain, "_tokens": token_estimate(F.col("text")) if tokens is None else tokens}
    names["_hash"] = F.xxhash64("text")  # before any join, so that counting the order's cells moves no text
    rows = docs.withColumns(names).select(
        *[F.col(c).alias(f"in_{c}") for c in docs.columns], F.col("_domain").alias("domain"), "lang", "source", F.col("_tokens").alias("tokens"), "_hash"
    )
    leaves = materialize(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")))
    plan = budgets(leaves, share, epochs, weights)
    plan = plan.select(
        *[F.col(k).alias(f"_{k}") for k in LEVELS],
        "budget",
        F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(1)).alias("whole"),
        F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(F.lit(0)).alias("part"),
    )
    rows = rows.join(plan, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in LEVELS])
    place = ranks.seeded(F.concat_ws("/", F.lit(seed), F.col("whole")), F.col("in_doc_id"), F.col("_hash"))  # its own order each epoch
    rows = rows.withColumns({"_place": place, "_bytes": F.crc32(F.coalesce(F.col("in_text"), F.lit("")).cast("binary"))})
    rows = ranks.running(rows, [f"_{k}" for k in LEVELS], "_place", ["in_doc_id", "_bytes"], F.col("tokens"), "end")
    copies = F.col("whole") + F.when(F.col("end") <= F.col("part"), 1).otherwise(0)
    return rows.select(
        *[F.col(f"in_{c}").alias(c) for c in docs.columns], "domain", "tokens", "budget", copies.cast("int").alias("copies")
    )


def take(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows with the columns of ``docs``; a row of several epochs appears as often."""
    mixed = mix(docs, **options).filter("copies > 0")
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op5: how often each of ``documents`` is taken under the production weights."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    return mix(docs).select("doc_id", "domain", "lang", "source", "tokens", "budget", "copies")
