"""Shapley attribution of flagged windows over an isolation forest, ranking and summaries.

The explained value is the mean path length. For one tree leaf, a flagged row and a background row, the
features on the leaf's path split into those only the flagged row satisfies and those only the background
row satisfies; the leaf then contributes closed-form Shapley weights (interventional tree Shapley).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.functions.scalars import direction
from vigilspark.operators.forest import Forest, average_path, node_table

# Fixed text of an explanation: headings, and the line formats.
HEAD = "Anomaly Detection Explanation:"
HEAD_ANOMALY = "Top factors indicating ANOMALY:"
HEAD_NORMAL = "Top factors indicating NORMAL:"
LINE_ANOMALY = "  - %s: %.4f"
LINE_NORMAL = "  - %s: +%.4f"
LINE_NET = "Net SHAP impact: %.4f"
LINE_SUM_ANOMALY = "  Anomaly factors: %.4f"
LINE_SUM_NORMAL = "  Normal factors:  +%.4f"


def _leaf_boxes(table: pd.DataFrame) -> list[tuple[np.ndarray, ...]]:
    """Per tree: leaf values, and per leaf and slot a feature with its (low, high] interval; slot -1 is unused."""
    out = []
    for _, t in table.groupby("tree", sort=True):
        feature, split = t["feature"].to_numpy(), t["split"].to_numpy()
        left, right = t["left"].to_numpy(), t["right"].to_numpy()
        value = t["depth"].to_numpy(float) + average_path(t["n"].to_numpy())
        leaves, stack = [], [(0, {})]
        while stack:
            at, box = stack.pop()
            f = int(feature[at])
            if f < 0:
                leaves.append((value[at], box))
                continue
            low, high = box.get(f, (-np.inf, np.inf))
            stack.append((int(left[at]), {**box, f: (low, min(high, split[at]))}))
            stack.append((int(right[at]), {**box, f: (max(low, split[at]), high)}))
        slots = max((len(b) for _, b in leaves), default=0) or 1
        feats = np.full((len(leaves), slots), -1)
        lows, highs = np.full(feats.shape, -np.inf), np.full(feats.shape, np.inf)
        for i, (_, box) in enumerate(leaves):
            for j, (f, (low, high)) in enumerate(box.items()):
                feats[i, j], lows[i, j], highs[i, j] = f, low, high
        out.append((np.array([v for v, _ in leaves]), feats, lows, highs))
    return out


def _weights(slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Shapley weight of one feature in the row-only set and in the background-only set, by set sizes (u, v)."""
    gain, loss = np.zeros((slots + 1, slots + 1)), np.zeros((slots + 1, slots + 1))
    for u in range(slots + 1):
        for v in range(slots + 1 - u):
            if u:
                gain[u, v] = factorial(u - 1) * factorial(v) / factorial(u + v)
            if v:
                loss[u, v] = factorial(u) * factorial(v - 1) / factorial(u + v)
    return gain, loss


def _inside(feats: np.ndarray, lows: np.ndarray, highs: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bit j of (row, leaf): the row meets the leaf's condition j; conditions that a leaf has not are met."""
    at = np.maximum(feats, 0)
    out = np.zeros((len(x), len(feats)), dtype=np.int64)
    for j in range(feats.shape[1]):
        value = x[:, at[:, j]]
        out |= ((feats[:, j] < 0) | ((value > lows[:, j]) & (value <= highs[:, j]))).astype(np.int64) << j
    return out


class Explainer:
    """Attributions of many rows against all background rows; those of a row sum to f(x) - mean f(background).

    What the background rows meet is kept as bit masks, a number for each (background row, leaf). A block of rows is
    compared with them at once, and only leaves that row and background row reach together are looked at further.
    """

    def __init__(self, boxes: list[tuple[np.ndarray, ...]], background: np.ndarray, block: int = 32):
        self.background, self.block, self.trees = background, block, []
        for value, feats, lows, highs in boxes:
            tables = _weights(feats.shape[1])
            self.trees.append((value, feats, lows, highs, _inside(feats, lows, highs, background), *tables))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        parts = [self._block(x[i : i + self.block]) for i in range(0, len(x), self.block)]
        return np.concatenate(parts) if parts else np.zeros((0, self.background.shape[1]))

    def _block(self, x: np.ndarray) -> np.ndarray:
        n, width = x.shape
        phi = np.zeros(n * width)
        for value, feats, lows, highs, back, gain, loss in self.trees:
            slots = feats.shape[1]
            mine = _inside(feats, lows, highs, x)
            row, other, leaf = np.nonzero((mine[:, None, :] | back[None, :, :]) == (1 << slots) - 1)
            a, b = mine[row, leaf], back[other, leaf]
            row_only, back_only = a & ~b, b & ~a
            u, v = np.bitwise_count(row_only), np.bitwise_count(back_only)
            up, down = gain[u, v] * value[leaf], loss[u, v] * value[leaf]
            for j in range(slots):
                part = ((row_only >> j) & 1) * up - ((back_only >> j) & 1) * down
                phi += np.bincount(row * width + np.maximum(feats[leaf, j], 0), part, minlength=n * width)
        return phi.reshape(n, width) / (max(1, len(self.trees)) * len(self.background))


def attribute(scored: DataFrame, forest: Forest, flagged_only: bool = True) -> DataFrame:
    """Add ``shap`` (array in feature order) and ``base_value`` to flagged scored rows.

    Model and background are bounded tables and travel with the function; rows are spread over tasks.
    """
    boxes = _leaf_boxes(node_table(forest.nodes))
    background = np.vstack([np.asarray(r["vector"]) for r in forest.background.collect()])  # at most 100 rows

    def value_of(x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for value, feats, lows, highs in boxes:
            at = np.maximum(feats, 0)
            inside = ((feats < 0) | ((x[:, at] > lows) & (x[:, at] <= highs))).all(axis=2)
            total += inside @ value
        return total / max(1, len(boxes))

    base = float(value_of(background).mean())

    @F.pandas_udf("array<double>")
    def explain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        explainer = Explainer(boxes, background)  # once a task
        for vectors in batches:
            x = np.vstack(vectors.to_numpy()) if len(vectors) else np.zeros((0, background.shape[1]))
            yield pd.Series(list(explainer(x)), dtype=object)

    rows = scored.where("is_anomaly") if flagged_only else scored
    return rows.repartition(F.xxhash64("vector")).withColumn("shap", explain("vector")).withColumn("base_value", F.lit(base))


def ranked_attributions(long: DataFrame, keys: list[str], k: int | None = None) -> DataFrame:
    """Rank long attributions (keys, feature, value, shap) by absolute size, first feature name on ties."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.abs("shap")), "feature")
    ranked = long.withColumn("rank", F.row_number().over(order)).withColumn("direction", direction(F.col("shap")))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def signed_contributors(long: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """Up to ``k`` most negative and ``k`` most positive attributions of each key."""
    side = F.when(F.col("shap") < 0, "negative").otherwise("positive")
    order = Window.partitionBy(*keys, "side").orderBy(F.desc(F.abs("shap")), "feature")
    return (
        long.where(F.col("shap") != 0)
        .withColumn("side", side)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )


def attribution_summary(long: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """Sums of the top contributors on each side, their net, and the explanation text."""
    top = signed_contributors(long, keys, k)
    negative = F.col("side") == "negative"
    sums = top.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(negative, F.col("shap"))), F.lit(0.0)).alias("negative_sum"),
        F.coalesce(F.sum(F.when(~negative, F.col("shap"))), F.lit(0.0)).alias("positive_sum"),
        F.array_sort(F.collect_list(F.when(negative, F.struct("rank", "feature", "shap")))).alias("_neg"),
        F.array_sort(F.collect_list(F.when(~negative, F.struct("rank", "feature", "shap")))).alias("_pos"),
    )

    def _four(value: Column | str) -> Column:
        return F.round(F.round(value, 6), 4)

    def block(head: str, items: str, pattern: str) -> Column:
        lines = F.transform(items, lambda x: F.format_string(pattern, x["feature"], _four(x["shap"])))
        return F.when(F.size(items) > 0, F.concat(F.lit(f"{head}\n"), F.array_join(lines, "\n"), F.lit("\n")))

    net = F.col("negative_sum") + F.col("positive_sum")
    text = F.concat_ws(
        "\n",
        F.lit(f"{HEAD}\n"),
        block(HEAD_ANOMALY, "_neg", LINE_ANOMALY),
        block(HEAD_NORMAL, "_pos", LINE_NORMAL),
        F.format_string(LINE_NET, _four(net)),
        F.format_string(LINE_SUM_ANOMALY, _four("negative_sum")),
        F.format_string(LINE_SUM_NORMAL, _four("positive_sum")),
    )
    return sums.withColumn("net", net).withColumn("text", text).drop("_neg", "_pos")
