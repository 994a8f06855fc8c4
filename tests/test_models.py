"""Modelling operators checked against direct NumPy computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendscope.operators import models as md
from lendscope.sources.loan_book import loan_book
from tests.conftest import SMOKE


def _newton_logit(X, y, iters=50):
    Xc = np.column_stack([np.ones(len(X)), X])
    b = np.zeros(Xc.shape[1])
    for _ in range(iters):
        p = 1 / (1 + np.exp(-Xc @ b))
        W = p * (1 - p)
        H = Xc.T @ (Xc * W[:, None])
        b = b + np.linalg.solve(H, Xc.T @ (y - p))
    p = 1 / (1 + np.exp(-Xc @ b))
    se = np.sqrt(np.diag(np.linalg.inv(Xc.T @ (Xc * (p * (1 - p))[:, None]))))
    llf = float(np.sum(y * np.log(p) + (1 - y) * np.log(1 - p)))
    return b, se, llf


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(9)
    X = rng.normal(size=(600, 3))
    y = (rng.random(600) < 1 / (1 + np.exp(-(0.3 + X @ np.array([1.0, -0.5, 0.2]))))).astype(float)
    df = spark.createDataFrame([(i, *map(float, X[i]), int(y[i])) for i in range(600)],
                               "k long, a double, b double, c double, y int")
    return df, X, y


def test_logit_matches_newton(spark, data):
    df, X, y = data
    fit = md.fit_logit(df, ["a", "b", "c"], "y")
    b, se, llf = _newton_logit(X, y)
    rows = {r[0]: r for r in fit.coefficient_rows()}
    for name, i in [("const", 0), ("a", 1), ("b", 2), ("c", 3)]:
        assert rows[name][1] == pytest.approx(b[i], abs=1e-6)
        assert rows[name][2] == pytest.approx(se[i], rel=1e-4)
    stats = md.fit_statistics(spark, fit).collect()[0]
    ybar = y.mean()
    llnull = len(y) * (ybar * math.log(ybar) + (1 - ybar) * math.log(1 - ybar))
    assert stats["llf"] == pytest.approx(llf, rel=1e-6)
    assert stats["mcfadden_r2"] == pytest.approx(1 - llf / llnull, rel=1e-5)
    table = md.coefficient_table(spark, fit).collect()
    assert [r["term"] for r in table][0] in {"a", "const", "b", "c"} and len(table) == 4


def test_vif_uncentered(spark, data):
    df, X, _ = data
    got = {r["feature"]: r["vif"] for r in md.vif(df, ["a", "b", "c"]).collect()}
    for i, c in enumerate(["a", "b", "c"]):
        others = np.delete(X, i, axis=1)
        coef, *_ = np.linalg.lstsq(others, X[:, i], rcond=None)
        rss = np.sum((X[:, i] - others @ coef) ** 2)
        r2 = 1 - rss / np.sum(X[:, i] ** 2)           # no constant: uncentered R2
        assert got[c] == pytest.approx(round(1 / (1 - r2), 4), abs=1e-4)


def test_exact_split_and_folds_keep_class_shares(spark):
    book = loan_book(spark, SMOKE).select("loan_id", "target")
    s = md.stratified_split(book, "loan_id", "target", 0.2, 42)
    per = {r["target"]: (r["n"], r["t"]) for r in s.groupBy("target").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).collect()}
    for n, t in per.values():
        assert t == round(0.2 * n)
    k = md.kfold(book, "loan_id", 5, 42, label="target")
    sizes = k.groupBy("target", "fold").count().collect()
    for cls in per:
        c = [r["count"] for r in sizes if r["target"] == cls]
        assert len(c) == 5 and max(c) - min(c) <= 1


def test_cv_search_returns_every_trial(spark, data):
    df, _, _ = data
    best, results = md.cv_search(df, ["a", "b", "c"], "y", "k", n_trials=2, k=3, parallelism=2)
    assert len(results) == 2 and all(0.5 < auc <= 1.0 for _, auc in results)


def test_boosted_search_space(spark, data):
    import random
    for _ in range(50):
        p = md.draw_params(md.BOOST_SPACE, random.Random(_))
        assert 50 <= p["maxIter"] <= 500 and 0.01 <= p["stepSize"] <= 0.30 and 3 <= p["maxDepth"] <= 10
    df, _, _ = data
    small = {"maxIter": ("int", 3, 5), "maxDepth": ("int", 2, 3), "stepSize": ("log", 0.05, 0.3)}
    _, results = md.cv_search(df, ["a", "b", "c"], "y", "k", n_trials=1, k=2, parallelism=1, kind="boosted",
                              space=small)
    (params, auc), = results
    assert 3 <= params["maxIter"] <= 5 and auc > 0.5


def test_vif_of_many_columns(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 70))
    cols = [f"c{i}" for i in range(70)]
    df = spark.createDataFrame([[float(v) for v in r] for r in x], ", ".join(f"{c} double" for c in cols))
    got = {r["feature"]: r["vif"] for r in md.vif(df, cols).collect()}
    g = x.T @ x
    inv = np.linalg.inv(g)
    for i in (0, 33, 69):
        assert got[cols[i]] == pytest.approx(g[i, i] * inv[i, i], abs=1e-3)


def test_split_plan_moves_no_rows(spark):
    """The split is a projection: no exchange and no window in its plan."""
    df = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("y"), F.lit("wide").alias("w"))
    out = md.stratified_split(df, "k", "y", 0.2, 1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    got = {r["y"]: r["n"] for r in out.where("is_test").groupBy("y").count().withColumnRenamed("count", "n").collect()}
    assert got == {1: 333, 0: 667}
    folds = md.kfold(df, "k", 5, 1, "y").groupBy("fold", "y").count().collect()
    assert all(abs(r["count"] - (1667 if r["y"] else 3333) / 5) < 1 for r in folds)


def test_folds_move_no_rows_and_keep_awkward_ones(spark):
    """No exchange, join or window in the plan; shared and null keys, null
    labels, few rows and an empty table."""
    df = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("y"), F.lit("wide").alias("w"))
    plan = md.kfold(df, "k", 5, 1, "y")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Window" not in plan
    odd = (df.withColumn("k", F.when(F.col("k") % 4 == 0, None).when(F.col("k") % 4 == 1, 7).otherwise(F.col("k")))
           .withColumn("y", F.when(F.col("y") == 1, F.col("y"))))
    out = md.kfold(odd, "k", 5, 1, "y")
    assert out.columns == ["k", "y", "w", "fold"] and out.count() == 5000 and out.where("fold NOT BETWEEN 0 AND 4").count() == 0
    assert out.groupBy("k", "y").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    assert out.select("fold").distinct().count() >= 3
    few = {r["fold"] for r in md.kfold(df.limit(2), "k", 5, 1, "w").collect()}
    assert few == {0, 1}
    assert md.kfold(df.limit(0), "k", 5, 1, "y").count() == 0


def test_the_registered_search_makes_all_trials(spark, monkeypatch):
    from lendscope.plans import model_queries as mq

    asked = {}
    monkeypatch.setattr(mq, "_raw_split", lambda s, d: (s.range(1).select(F.lit(False).alias("is_test")), []))
    monkeypatch.setattr(mq.md, "cv_search", lambda *a, **kw: asked.update(kw) or (None, [({"i": i}, 0.5) for i in range(kw["n_trials"])]))
    assert mq.cv_search_q(spark, "").count() == asked["n_trials"] == 50 and asked["k"] == 5
