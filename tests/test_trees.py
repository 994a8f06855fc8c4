"""Portable tree tables: scores equal Spark's own models, attributions equal
brute-force Shapley values and the recursive algorithm, awkward rows."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler, VectorIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lendscope.operators import attribution as A
from lendscope.operators import trees as T
from lendscope.session import ensure_checkpoint_dir
from tests.test_attribution import _brute_shap

FEATS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(9)
    X = rng.normal(size=(500, 4))
    X[:, 3] = rng.integers(0, 5, 500)          # categorical
    y = (X[:, 0] + 0.5 * X[:, 1] * X[:, 2] + np.isin(X[:, 3], [1, 4]) + rng.normal(scale=0.5, size=500)) > 0.4
    rows = [(i, *map(float, X[i]), float(y[i])) for i in range(500)]
    return spark.createDataFrame(rows, "k long, a double, b double, c double, d double, y double"), X


def _fit(spark, df, kind, categorical, depth=4):
    data = VectorAssembler(inputCols=FEATS, outputCol="v" if categorical else "features").transform(df)
    if categorical:
        data = VectorIndexer(inputCol="v", outputCol="features", maxCategories=6).fit(data).transform(data)
    est = (GBTClassifier(labelCol="y", maxIter=6, maxDepth=depth, seed=1) if kind == "boosted"
           else RandomForestClassifier(labelCol="y", numTrees=5, maxDepth=depth, seed=1))
    model = est.fit(data)
    return model, data, A.ensemble_from_model(model, ensure_checkpoint_dir(spark)), T.tree_table(model, FEATS, ensure_checkpoint_dir(spark))


@pytest.mark.parametrize("categorical", [False, True])
@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_scores_and_attributions(spark, data, kind, categorical):
    df, X = data
    model, vectors, ens, table = _fit(spark, df, kind, categorical)
    assert any(n["categories"] is not None for n in table.nodes) == categorical
    want = {r["k"]: r["p"] for r in model.transform(vectors).select("k", vector_to_array("probability")[1].alias("p")).collect()}
    got = {r["k"]: r for r in T.score(df, table, "pd", "raw").collect()}
    assert got.keys() == want.keys()
    assert all(got[k]["pd"] == pytest.approx(want[k], abs=1e-12) for k in want)
    phi = A.shap_values(X, ens)                # the recursion, tested against brute force itself
    expl: dict = {}
    for r in T.explain(df, table, "k").collect():
        expl.setdefault(r["k"], {})[r["feature"]] = r["shap"]
    assert len(expl) == 500
    for k in range(500):
        mine = [expl[k][f] for f in FEATS]
        assert np.allclose(mine, phi[k], atol=1e-9)
        assert table.expected_value() + sum(mine) == pytest.approx(got[k]["raw"], abs=1e-9)
    if not categorical:
        for r in range(5):
            brute = sum(w * _brute_shap(t, X[r], 4) for t, w in zip(ens.trees, ens.weights)) * ens.scale
            assert np.allclose([expl[r][f] for f in FEATS], brute, atol=1e-9)


def test_round_trip_and_frames(spark, data):
    df, _ = data
    _, _, _, table = _fit(spark, df, "forest", True)
    again = T.TreeTable.from_json(table.to_json())
    assert again == table
    assert T.node_frame(spark, table).count() == len(table.nodes)
    leaves = {(n["tree"], n["node"]) for n in table.nodes if n["left"] < 0}
    path = T.path_frame(spark, table)
    assert {(r["tree"], r["leaf"]) for r in path.select("tree", "leaf").distinct().collect()} == leaves
    assert path.groupBy("tree", "leaf", "feature").count().where("count > 1").count() == 0


def test_awkward_rows(spark, data):
    df, _ = data
    model, _, _, table = _fit(spark, df, "boosted", False)
    nan = float("nan")
    odd = spark.createDataFrame([(1, None, 0.1, 0.2, 1.0, "u"), (1, nan, 0.1, 0.2, 1.0, "v"), (None, 1e300, -1e300, None, None, "w")],
                                "k long, a double, b double, c double, d double, n string")
    vec = VectorAssembler(inputCols=FEATS, outputCol="features", handleInvalid="keep").transform(odd.na.fill(nan, FEATS))
    want = {r["n"]: r["p"] for r in model.transform(vec).select("n", vector_to_array("probability")[1].alias("p")).collect()}
    got = {r["n"]: r["pd"] for r in T.score(odd, table).collect()}
    assert got == pytest.approx(want, abs=1e-12)
    twice = odd.unionByName(odd)               # repeated and null keys, equal rows
    assert T.explain(odd, table, "k").count() == 12 and T.explain(twice, table, "k").count() == 24
    assert T.score(df.limit(0), table).count() == 0 and T.explain(df.limit(0), table, "k").count() == 0
    stump = T.TreeTable(FEATS, "forest", [1.0], [{"tree": 0, "node": 0, "feature": -1, "threshold": None, "categories": None,
                                                  "left": -1, "right": -1, "value": 0.3, "cover": 5.0}])
    assert {r["pd"] for r in T.score(df, stump).collect()} == {0.3}
    assert {r["shap"] for r in T.explain(df, stump, "k").collect()} == {0.0}


def test_plan_is_narrow(spark, data):
    df, _ = data
    _, _, _, table = _fit(spark, df, "boosted", False)
    plan = T.score(df, table)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Pandas" not in plan and "from_json" not in plan
    plan = T.explain(df, table, "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Pandas" not in plan


def test_model_size_is_checked():
    with pytest.raises(ValueError):
        T._constant("x" * (T.MAX_MODEL_BYTES + 1), "string")
