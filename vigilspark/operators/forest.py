"""Isolation Forest as Spark jobs: distributed sub-sampling, one small task per tree, Arrow scoring.

Follows the published algorithm (Liu, Ting and Zhou, 2008): trees on sub-samples of at most 256 rows,
score ``-2 ** (-mean path / c(n))`` shifted by the contamination quantile of the training scores.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilspark.operators.features import fit_scaler, scale, vector
from vigilspark.plans.ordering import exact_percentiles
from vigilspark.schema import FEATURE_NAMES
from vigilspark.session import materialize

NODE_SCHEMA = "tree int, node int, feature int, split double, left int, right int, n int, depth int"
MIN_WINDOWS = 10
BACKGROUND_ROWS = 100


def average_path(n: np.ndarray | float) -> np.ndarray:
    """c(n): mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    m = np.where(big, n, 3.0)
    return np.where(big, 2.0 * (np.log(m - 1.0) + np.euler_gamma) - 2.0 * (m - 1.0) / m, out)


def _grow(rows: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes of one isolation tree: (node, feature, split, left, right, n, depth); feature -1 is a leaf."""
    nodes: list[list] = []
    todo = [(rows, 0, -1, 0)]
    while todo:
        part, depth, parent, side = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][3 + side] = me
        low, high = part.min(axis=0), part.max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth >= limit or len(part) <= 1 or len(open_features) == 0:
            nodes.append([me, -1, 0.0, -1, -1, len(part), depth])
            continue
        f = int(rng.choice(open_features))
        cut = float(rng.uniform(low[f], high[f]))
        goes_left = part[:, f] <= cut
        if goes_left.all():  # the draw hit the upper end
            cut = float(low[f])
            goes_left = part[:, f] <= cut
        nodes.append([me, f, cut, -1, -1, len(part), depth])
        todo.append((part[goes_left], depth + 1, me, 0))
        todo.append((part[~goes_left], depth + 1, me, 1))
    return [tuple(x) for x in nodes]


@dataclass
class Forest:
    """A fitted model: four small tables.

    ``nodes`` at most trees x 511 rows, ``scaler`` one row, ``meta`` one row, ``background`` at most 100 rows.
    """

    nodes: DataFrame
    scaler: DataFrame
    meta: DataFrame
    background: DataFrame
    names: tuple[str, ...] = tuple(FEATURE_NAMES)

    def save(self, path: str) -> None:
        for name in ("nodes", "scaler", "meta", "background"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Forest":
        parts = [spark.read.parquet(f"{path}/{n}") for n in ("nodes", "scaler", "meta", "background")]
        return cls(*parts, tuple(parts[2].first()["feature_names"]))


def subsample(scaled: DataFrame, key: str, trees: int, size: int, seed: int) -> DataFrame:
    """For every tree the ``size`` rows with the smallest hash of (key, tree, seed): tree, _r (from 1), vector.

    A first pass over hashes alone finds each tree's bound (tasks keep ``size`` hashes a tree before the shuffle), a
    second one picks the rows under the bounds, so vectors are copied for picked rows only. One rule at any size; the
    result depends on the rows only, not on their partitioning. A tree without ``size`` rows is an error.
    """
    rows = scaled.select(F.col(key).alias("_key"), "vector", F.xxhash64(key).alias("_row"))
    each = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    hashed = F.xxhash64("_row", "tree", F.lit(seed))
    least = Window.partitionBy("tree").orderBy("_h")
    bottom = rows.select("_row", each).select("tree", hashed.alias("_h")).withColumn("_n", F.row_number().over(least)).where(F.col("_n") <= size)
    bounds = {r["tree"]: (r["n"], r["bound"]) for r in bottom.groupBy("tree").agg(F.count("*").alias("n"), F.max("_h").alias("bound")).collect()}
    short = [t for t in range(trees) if bounds.get(t, (0, None))[0] != size]  # a row per tree reaches the driver
    if short:
        raise ValueError(f"trees without {size} training rows: {short}")
    bound = F.element_at(F.array(*[F.lit(bounds[t][1]) for t in range(trees)]), F.col("tree") + 1)
    picked = rows.select("_key", "vector", "_row", each).withColumn("_h", hashed).where(F.col("_h") <= bound)
    order = Window.partitionBy("tree").orderBy("_h", "_key")  # rows of one key have one hash; some of them may be too many
    return picked.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= size)


def fit(
    features: DataFrame,
    key: str,
    names: Sequence[str] = FEATURE_NAMES,
    trees: int = 100,
    max_samples: int = 256,
    contamination: float = 0.05,
    threshold: float = -0.7,
    seed: int = 42,
    trained_at: datetime | None = None,
) -> Forest:
    """Fit on feature rows; ``key`` names each row. The rows are written once and re-read."""
    names = tuple(names)
    rows = materialize(features.select(key, *[F.col(f"`{n}`").cast("double").alias(n) for n in names]))
    n_rows = rows.count()
    if n_rows < MIN_WINDOWS:
        raise ValueError(f"too few training windows: {n_rows} < {MIN_WINDOWS}")
    psi = min(max_samples, n_rows)
    limit = int(np.ceil(np.log2(max(psi, 2))))
    scaler = materialize(fit_scaler(rows, names))
    scaled = scale(rows, scaler, names).select(key, vector(names).alias("vector"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        matrix = np.vstack(pdf.sort_values("_r")["vector"].to_numpy())
        table = pd.DataFrame(
            _grow(matrix, np.random.default_rng([seed, tree]), limit),
            columns=["node", "feature", "split", "left", "right", "n", "depth"],
        )
        table.insert(0, "tree", tree)
        return table

    nodes = materialize(
        subsample(scaled, key, trees, psi, seed)
        .select("tree", "_r", "vector")
        .groupBy("tree")
        .applyInPandas(grow, NODE_SCHEMA)
    )
    path_scores = scaled.withColumn("raw", raw_score(nodes, psi)(F.col("vector")))
    offset = exact_percentiles(path_scores.select("raw"), [], "raw", {"offset": contamination})
    stamp = F.lit(trained_at) if trained_at else F.lit(datetime.now(timezone.utc))
    meta = materialize(
        offset.select(
            "offset",
            F.lit(psi).alias("psi"),
            F.lit(trees).alias("trees"),
            F.lit(float(contamination)).alias("contamination"),
            F.lit(float(threshold)).alias("threshold"),
            F.lit(seed).alias("seed"),
            F.lit(n_rows).cast("bigint").alias("training_rows"),
            stamp.cast("timestamp").alias("training_date"),
            F.array(*[F.lit(n) for n in names]).alias("feature_names"),
        )
    )
    named = scaled.select(F.col(key).cast("string").alias("key"), "vector")
    order = F.md5(F.concat_ws(":", "key", F.lit(str(seed))))
    background = materialize(named.withColumn("_h", order).orderBy("_h", "key").limit(BACKGROUND_ROWS).select("key", "vector"))
    return Forest(nodes, scaler, meta, background, names)


def node_table(nodes: DataFrame) -> pd.DataFrame:
    """The node table in driver memory; bounded by trees x (2 x 256 - 1) rows."""
    return nodes.toPandas().sort_values(["tree", "node"])


def packed(table: pd.DataFrame) -> list[tuple[np.ndarray, ...]]:
    """A tuple of arrays for each tree: feature, split, left, right, path length."""
    out = []
    for _, t in table.groupby("tree", sort=True):
        length = t["depth"].to_numpy(float) + average_path(t["n"].to_numpy())
        out.append(tuple(t[c].to_numpy() for c in ("feature", "split", "left", "right")) + (length,))
    return out


def mean_path(trees: list[tuple[np.ndarray, ...]], x: np.ndarray) -> np.ndarray:
    """Mean path length of each row over all trees."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for feature, split, left, right, length in trees:
        at = np.zeros(len(x), dtype=int)
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            down = np.where(x[rows, np.maximum(f, 0)] <= split[at], left[at], right[at])
            at = np.where(inner, down, at)
        total += length[at]
    return total / max(1, len(trees))


def raw_score(nodes: DataFrame, psi: int):
    """A column function: scaled feature vector to ``-2 ** (-mean path / c(psi))``."""
    trees = packed(node_table(nodes))
    norm = float(average_path(psi)) or 1.0

    @F.pandas_udf("double")
    def score(vectors: pd.Series) -> pd.Series:
        if len(vectors) == 0:
            return pd.Series([], dtype="float64")
        x = np.vstack(vectors.to_numpy())
        return pd.Series(-np.power(2.0, -mean_path(trees, x) / norm))

    return score


def decision(forest: Forest) -> tuple[Column, dict]:
    """Score expression over a ``vector`` column, and the model's one meta row."""
    meta = forest.meta.first().asDict()
    return raw_score(forest.nodes, meta["psi"])(F.col("vector")) - F.lit(meta["offset"]), meta


def score(features: DataFrame, forest: Forest, threshold: float | None = None) -> DataFrame:
    """Add ``score``, ``threshold``, ``is_anomaly`` and the scaled ``vector`` to feature rows."""
    expression, meta = decision(forest)
    limit = meta["threshold"] if threshold is None else threshold
    scaled = scale(
        features.select("*", *[F.col(f"`{n}`").alias(f"_raw_{n}") for n in forest.names]), forest.scaler, forest.names
    ).withColumn("vector", vector(forest.names))
    restored = scaled.select(
        *[c for c in features.columns if c not in forest.names],
        *[F.col(f"`_raw_{n}`").alias(n) for n in forest.names],
        "vector",
    )
    return (
        restored.withColumn("score", expression)
        .withColumn("threshold", F.lit(float(limit)))
        .withColumn("is_anomaly", F.col("score") < F.col("threshold"))
    )


def training_stats(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count("*").alias("n_windows"),
        F.count_if("is_anomaly").alias("anomalies_in_training"),
        F.avg("score").alias("score_mean"),
        F.stddev_pop("score").alias("score_std"),
        F.min("score").alias("score_min"),
        F.max("score").alias("score_max"),
    )


def contamination_runs(features: DataFrame, forest: Forest, contaminations: Sequence[float]) -> DataFrame:
    """(contamination, offset): contamination only moves the offset, so rows are scored once."""
    expression, meta = decision(forest)
    scaled = scale(features, forest.scaler, forest.names).withColumn("vector", vector(forest.names))
    raw = scaled.select((expression + F.lit(meta["offset"])).alias("raw"))
    names = {f"c{i}": c for i, c in enumerate(contaminations)}
    wide = exact_percentiles(raw, [], "raw", names)
    pairs = F.array(*[F.struct(F.lit(float(c)).alias("contamination"), F.col(n).alias("offset")) for n, c in names.items()])
    return wide.select(F.inline(pairs))
