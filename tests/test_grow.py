"""Trees grown in Spark passes: sums and splits against brute force, scores
against Spark ML's estimators."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from lendscope.operators import attribution as A
from lendscope.operators import grow
from lendscope.operators import models as md

FEATS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    X = np.column_stack([rng.normal(size=(4000, 2)), rng.integers(0, 5, 4000)])
    y = (X[:, 0] + X[:, 1] * (X[:, 2] - 2) + rng.normal(size=4000) > 0.3).astype(int)
    X[::50, 1] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in X[i]], int(y[i])) for i in range(4000)]
    return spark.createDataFrame(rows, "k long, a double, b double, c double, y int"), X, y


def _gini(y):
    p = y.mean() if len(y) else 0.0
    return 2 * p * (1 - p)


def test_one_tree_has_the_best_splits(spark, data):
    """A single tree sees every row and feature: each split is the best of all."""
    df, X, y = data
    edges = grow.bin_edges(df, FEATS)
    ens, = grow.forest(grow.binned(df, FEATS, "y", edges), edges, {0: 1.0, 1: 1.0}, [-1], 1, 2, 5, "all", 1)
    tree = ens.trees[0]

    def best(at):
        found = (0, None)
        for j, cuts in enumerate(edges):
            for cut in cuts:
                left = X[at, j] <= cut
                if min(left.sum(), (~left).sum()) >= 5:
                    gain = _gini(y[at]) - (left.mean() * _gini(y[at][left]) + (~left).mean() * _gini(y[at][~left]))
                    found = max(found, (gain, (j, cut)), key=lambda g: g[0])
        return found[1]

    assert best(np.arange(4000)) == (tree.feature[0], tree.threshold[0])
    for side, child in ((X[:, tree.feature[0]] <= tree.threshold[0], tree.left[0]), (~(X[:, tree.feature[0]] <= tree.threshold[0]), tree.right[0])):
        assert tree.cover[child] == side.sum() and tree.value[child] == pytest.approx(y[side].mean())
        if tree.left[child] >= 0:
            assert best(np.flatnonzero(side)) == (tree.feature[child], tree.threshold[child])


def test_forest_agrees_with_spark(spark, data):
    df = data[0].na.drop()                                  # Spark ML refuses NaN
    ours = md.fit_forest(df, FEATS, "y", num_trees=60, max_depth=6)
    theirs = RandomForestClassifier(labelCol="y", featuresCol="features", weightCol="weight", numTrees=60, maxDepth=6, minInstancesPerNode=2,
                                    featureSubsetStrategy="sqrt", seed=3).fit(md._assemble(md.balanced_weights(df, "y"), FEATS))
    assert isinstance(ours, A.Ensemble)
    both = md.positive_prob(ours, df, FEATS, "p").join(md.positive_prob(theirs, df, FEATS, "q").select("k", "q"), "k").select("p", "q").toPandas()
    assert abs(both.p - both.q).mean() < 0.03 and np.corrcoef(both.p, both.q)[0, 1] > 0.98


def test_boosting_follows_the_gradient(spark, data):
    df, X, y = data
    model = md.fit_boosted(df, FEATS, "y", rounds=23, max_depth=3, step=0.3, subsample=1.0)   # past a checkpoint
    assert len(model.trees) == 23 and model.weights == [1.0] + [0.3] * 22
    spw, margin = round((y == 0).sum() / (y == 1).sum(), 4), np.zeros(4000)
    w = np.where(y == 1, spw, 1.0)
    for tree, step in zip(model.trees, model.weights):
        sign = 2.0 * y - 1
        target = sign if not margin.any() else 4 * sign / (1 + np.exp(2 * sign * margin))
        node = np.zeros(4000, dtype=int)
        for _ in range(3):
            inner = tree.left[node] >= 0
            goes = X[np.arange(4000), np.where(inner, tree.feature[node], 0)] <= tree.threshold[node]
            node = np.where(inner, np.where(goes, tree.left[node], tree.right[node]), node)
        for leaf in np.unique(node):
            assert tree.value[leaf] == pytest.approx(np.average(target[node == leaf], weights=w[node == leaf]), abs=1e-5)
        margin = margin + step * tree.value[node]
    got = md.positive_prob(model, df, FEATS, "p").orderBy("k").toPandas().p
    assert np.allclose(got, 1 / (1 + np.exp(-2 * margin)), atol=1e-9)


def test_counts_of_a_task_do_not_grow_with_the_rows(spark, data):
    """A tree of many nodes and many rows: no fold's rows reach its forest."""
    df, X, y = data
    folded = df.withColumn("fold", (F.col("k") % 2).cast("int"))
    edges = grow.bin_edges(df, FEATS)
    blocks = grow.binned(folded, FEATS, "y", edges, "fold")
    got = grow.forest(blocks, edges, {0: 1.0, 1: 1.0}, [0, 1], 1, 10, 1, "all", 1)
    assert [e.trees[0].cover[0] for e in got] == [2000, 2000]
    assert got[0].trees[0].value[0] == pytest.approx(y[1::2].mean()) and len(got[0].trees[0].left) > 200
    assert grow._packs([32, 32, 8, 32, 6, 6, 6], 1) == [[0, 1], [3, 2], [4, 5, 6]]


def test_awkward_rows(spark, data):
    df, _, _ = data
    empty = md.fit_forest(df.limit(0), FEATS, "y", num_trees=2)
    assert [len(t.left) for t in empty.trees] == [1, 1]
    with pytest.raises(Exception, match="labels are 0 or 1"):
        md.fit_forest(df.withColumn("y", F.lit(None).cast("int")), FEATS, "y", num_trees=2)
    flat = md.fit_forest(df.withColumn("a", F.lit(None).cast("double")).withColumn("b", F.lit(1.0)), ["a", "b"], "y", num_trees=2)
    assert all(len(t.left) == 1 for t in flat.trees)


def test_a_forest_takes_a_job_a_level(spark, data):
    """All trees of a small table go down together, whatever their number and depth."""
    df, _, _ = data
    edges = grow.bin_edges(df, FEATS)
    blocks = grow.binned(df, FEATS, "y", edges)
    sc = spark.sparkContext
    sc.setJobGroup("forest-jobs", "jobs of a forest")
    try:
        ens, = grow.forest(blocks, edges, {0: 1.0, 1: 1.0}, [-1], 150, 5, 2, "sqrt", 7)
        jobs = len(sc.statusTracker().getJobIdsForGroup("forest-jobs"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(ens.trees) == 150 and jobs <= 5 + 1
    assert grow._group_size(720_000, 16, 7, 3, 13) > 64 and grow._group_size(50_000_000, 24, 7, 3, 13) * 2 * 50_000_000 <= grow.STATE_BYTES


def test_trials_of_a_search_share_trees_and_keep_their_results(spark, data):
    """Trials with the rules of a split in common, other numbers and depths of
    trees: each has the AUC of the forest that it would be alone, on both ways."""
    df, _, _ = data
    folded = md.kfold(df, "k", 3, 1, "y").persist()
    edges, weights = grow.bin_edges(folded, FEATS), md.class_weights(folded, "y")
    blocks = grow.binned(folded, FEATS, "y", edges, "fold")
    trials = [(5, 4, 2, "sqrt"), (9, 2, 2, "log2"), (3, 7, 2, "sqrt"), (4, 5, 1, "all"), (1, 3, 2, "all")]
    sc = spark.sparkContext
    sc.setJobGroup("search-jobs", "jobs of a search")
    try:
        here = grow.search_here(blocks, edges, weights, trials, 3, 7)
        jobs = len(sc.statusTracker().getJobIdsForGroup("search-jobs"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 2 and len(here) == 15
    far = md._forest_aucs(folded, "y", blocks, edges, weights, trials, 3, 7)
    assert far == here
    limit, grow.LOCAL_BYTES = grow.LOCAL_BYTES, 0
    try:
        far = md._forest_aucs(folded, "y", blocks, edges, weights, trials, 3, 7)
    finally:
        grow.LOCAL_BYTES = limit
    assert far == pytest.approx(here, abs=1e-12)
    ev = md.BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="p", numBins=0)
    for i, (n, depth, least, subset) in enumerate(trials):
        alone = grow.forest(blocks, edges, weights, [0, 1, 2], n, depth, least, subset, 7)
        for fold, model in enumerate(alone):
            held = folded.where(F.col("fold") == fold).withColumn("p", F.round(grow.probability({-1: model}, FEATS), 12))
            assert ev.evaluate(held) == pytest.approx(here[i, fold], abs=1e-6)
    folded.unpersist()
