"""Connected components of a graph that no machine could hold: least labels and pointer jumping, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.session import discard, materialize


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges``: a, b. Returns node and comp, the least node that links reach.

    Each round takes the least label of all neighbours and then that label's own label, so the number of rounds
    grows with the logarithm of the longest chain. Labels are written between rounds and
    the ones before removed.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    table = labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("comp")))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        seen = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        seen = materialize(seen.join(up, "comp", "left").select("node", "was", F.least("comp", F.coalesce("up", "comp")).alias("comp")))
        discard(table)
        table, labels = seen, seen.select("node", "comp")
        if not seen.filter("comp <> was").limit(1).count():
            discard(both)
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
