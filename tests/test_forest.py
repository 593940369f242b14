"""Isolation forest and attribution: definition, reproducibility, ranking and additivity."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilspark.operators import attribution, forest

NAMES = ("a", "b", "c")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(9)
    rows = [(i, *map(float, rng.normal(0, 1, 3))) for i in range(600)] + [(600, 9.0, 9.0, -9.0)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double")


@pytest.fixture(scope="module")
def model(data):
    return forest.fit(data, "id", NAMES, trees=50, threshold=0.0)


def test_average_path():
    assert np.allclose(forest.average_path(np.array([0, 1, 2])), [0, 0, 1])
    assert np.isclose(forest.average_path(256.0), 2 * (np.log(255) + np.euler_gamma) - 2 * 255 / 256)


def test_tree_sizes(model):
    t = model.nodes.toPandas()
    assert t["tree"].nunique() == 50 and t.groupby("tree").size().max() <= 511 and t["depth"].max() <= 8
    assert (t[t["node"] == 0]["n"] == 256).all()
    assert (t[t["feature"] < 0].groupby("tree")["n"].sum() == 256).all()


def test_outlier_is_lowest_and_contamination_share_is_flagged(data, model):
    scored = forest.score(data, model).select("id", "score", "is_anomaly", "a").toPandas()
    assert scored.loc[scored["score"].idxmin(), "id"] == 600 and scored.loc[scored["id"] == 600, "a"].iloc[0] == 9.0
    assert abs(scored["is_anomaly"].mean() - 0.05) < 0.01
    offset = model.meta.first()["offset"]
    assert (-1 <= scored["score"] + offset).all() and (scored["score"] + offset <= 0).all()


def test_partitioning_does_not_change_the_model(data, model):
    again = forest.fit(data.repartition(13), "id", NAMES, trees=50, threshold=0.0)
    keys = ["tree", "node"]
    a, b = (m.nodes.toPandas().sort_values(keys).reset_index(drop=True) for m in (model, again))
    assert a.drop(columns="split").equals(b.drop(columns="split"))
    assert np.allclose(a["split"], b["split"], rtol=1e-9)  # sums of the scaler may differ in the last digits


def test_subsample_takes_the_smallest_hashes(spark, data):
    from vigilspark.operators.features import vector

    rows = data.select("id", vector(NAMES).alias("vector"))
    got = forest.subsample(rows, "id", 4, 20, 42).collect()
    tree = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("tree")
    hashes = rows.select("id", F.xxhash64("id").alias("r"), tree).select("id", "tree", F.xxhash64("r", "tree", F.lit(42)).alias("h")).collect()
    want = {(t, r["id"]) for t in range(4) for r in sorted((h for h in hashes if h["tree"] == t), key=lambda h: h["h"])[:20]}
    assert {(r["tree"], r["_key"]) for r in got} == want and len(got) == 80


def test_repeated_keys_fill_every_tree(spark, data):
    """600 rows of three keys: each tree still gets its rows, and too few rows are an error."""
    from vigilspark.operators.features import vector

    rows = data.select((F.col("id") % 3).alias("id"), vector(NAMES).alias("vector"))
    counts = {r["tree"]: r["count"] for r in forest.subsample(rows, "id", 5, 64, 1).groupBy("tree").count().collect()}
    assert counts == {t: 64 for t in range(5)}
    with pytest.raises(ValueError, match="training rows"):
        forest.subsample(rows.limit(10), "id", 5, 64, 1)


def test_too_few_windows(data):
    with pytest.raises(ValueError):
        forest.fit(data.limit(9), "id", NAMES)


def test_save_and_load(spark, data, model, tmp_path):
    model.save(str(tmp_path / "m"))
    loaded = forest.Forest.load(spark, str(tmp_path / "m"))
    a = {r["id"]: r["score"] for r in forest.score(data, model).collect()}
    b = {r["id"]: r["score"] for r in forest.score(data, loaded).collect()}
    assert a == b and loaded.names == NAMES


def test_contamination_moves_only_the_offset(data, model):
    got = {r["contamination"]: r["offset"] for r in forest.contamination_runs(data, model, (0.01, 0.05, 0.2)).collect()}
    assert got[0.01] < got[0.05] < got[0.2] and np.isclose(got[0.05], model.meta.first()["offset"])


def test_attributions_add_up_and_match_enumeration(data, model):
    scored = forest.score(data, model)
    rows = attribution.attribute(scored, model).toPandas()
    trees = forest.packed(forest.node_table(model.nodes))
    x = np.vstack(rows["vector"])
    background = np.vstack([r["vector"] for r in model.background.collect()])
    f = lambda v: forest.mean_path(trees, np.atleast_2d(v))
    shap = np.vstack(rows["shap"])
    assert np.allclose(shap.sum(axis=1) + rows["base_value"], f(x), atol=1e-9)
    assert np.isclose(rows["base_value"].iloc[0], f(background).mean(), atol=1e-9)
    one, small = x[0], background[:5]
    boxes = attribution._leaf_boxes(forest.node_table(model.nodes))
    got = attribution.Explainer(boxes, small)(x[:1])[0]
    assert np.allclose(attribution.Explainer(boxes, background, block=3)(x), shap, atol=1e-12)
    want = np.zeros(3)
    from itertools import permutations

    for b in small:
        for order in permutations(range(3)):
            mixed, last = b.copy(), f(b)[0]
            for j in order:
                mixed[j] = one[j]
                now = f(mixed)[0]
                want[j] += (now - last) / 6 / len(small)
                last = now
    assert np.allclose(got, want, atol=1e-9)
