"""TreeSHAP: local accuracy and agreement with brute-force Shapley values."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from lendscope.operators import attribution as A
from lendscope.session import ensure_checkpoint_dir


def _data(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(400, 3))
    y = ((X[:, 0] + 0.5 * X[:, 1] * X[:, 2] + rng.normal(scale=0.5, size=400)) > 0).astype(float)
    rows = [(i, *map(float, X[i]), float(y[i])) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, y double")
    return df, VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df), X


def _tree_value(t, x, S):
    """Path-dependent conditional expectation E[f | x_S]."""
    def rec(node):
        if t.left[node] < 0:
            return t.value[node]
        f = t.feature[node]
        if f in S:
            go_left = x[f] <= t.threshold[node]
            return rec(t.left[node] if go_left else t.right[node])
        lc, rc = t.left[node], t.right[node]
        return (t.cover[lc] * rec(lc) + t.cover[rc] * rec(rc)) / t.cover[node]
    return rec(0)


def _brute_shap(t, x, m):
    phi = np.zeros(m)
    for i in range(m):
        others = [j for j in range(m) if j != i]
        for r in range(m):
            for S in itertools.combinations(others, r):
                wgt = math.factorial(r) * math.factorial(m - r - 1) / math.factorial(m)
                phi[i] += wgt * (_tree_value(t, x, set(S) | {i}) - _tree_value(t, x, set(S)))
    return phi


@pytest.mark.parametrize("kind", ["gbt", "rf"])
def test_tree_shap_exact_and_locally_accurate(spark, kind):
    df, data, X = _data(spark)
    est = (GBTClassifier(labelCol="y", maxIter=5, maxDepth=3, seed=1) if kind == "gbt"
           else RandomForestClassifier(labelCol="y", numTrees=4, maxDepth=3, seed=1))
    model = est.fit(data)
    ens = A.ensemble_from_model(model, ensure_checkpoint_dir(spark))
    phi = A.shap_values(X[:25], ens)
    # brute force per tree, weighted
    for r in range(5):
        want = sum(w * _brute_shap(t, X[r], 3) for t, w in zip(ens.trees, ens.weights)) * ens.scale
        assert np.allclose(phi[r], want, atol=1e-9)
    from pyspark.ml.functions import vector_to_array
    pred = model.transform(data).select("k", vector_to_array("rawPrediction" if kind == "gbt" else "probability")
                                        .alias("v")).orderBy("k").limit(25).collect()
    score = [(r["v"][1] - r["v"][0]) if kind == "gbt" else r["v"][1] for r in pred]
    for r in range(25):
        assert ens.expected_value() + phi[r].sum() == pytest.approx(score[r], abs=1e-9)
    expl = A.explain(df.limit(30), ens, ["a", "b", "c"], "k")
    assert expl.count() == 90
