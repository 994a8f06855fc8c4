"""Tree attribution (F14): path-dependent TreeSHAP for Spark ML tree
ensembles, run as ``mapInPandas`` over Arrow batches.

The fitted model's node table (tree, node, children, split, value, cover)
is read from the model's saved data -- its size is bounded by trees x
nodes, not by rows -- and shipped to the tasks.  For each batch of rows the
TreeSHAP recursion (Lundberg et al., 2018, Algorithm 2) walks every tree
once; what differs between rows (which child is "hot", the path weights)
is carried as NumPy vectors over the batch, so the per-row work is
vectorised and rows never leave their partition.

Values are on the model's score scale: log-odds for boosted trees
(2 x margin, Spark's logistic loss), probability of class 1 for forests.
Local accuracy holds: expected value + sum of attributions = score.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions of this module run inside Python workers (mapInPandas); ship them
# by value so executors need only NumPy/pandas, not this package.
try:
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except (ImportError, AttributeError, ValueError):  # pragma: no cover
    pass



@dataclass
class Tree:
    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    categories: list          # None or set of left categories per node
    value: np.ndarray
    cover: np.ndarray


@dataclass
class Ensemble:
    trees: list[Tree]
    weights: list[float]
    scale: float              # 2.0 for boosted log-odds, 1.0 for forest probability

    def expected_value(self) -> float:
        ev = 0.0
        for t, w in zip(self.trees, self.weights):
            leaves = t.left < 0
            ev += w * float((t.value[leaves] * t.cover[leaves]).sum() / t.cover[0])
        return ev * self.scale


def ensemble_from_model(model, scratch_dir: str) -> Ensemble:
    """The node table of a fitted model: read from a Spark GBT / random-forest
    classifier, or what ``grow`` made."""
    if isinstance(model, Ensemble):
        return model
    spark = SparkSession.getActiveSession()
    path = f"{scratch_dir.rstrip('/')}/tree-model-{uuid.uuid4().hex[:12]}"
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.impurityStats", "nodeData.leftChild",
        "nodeData.rightChild", "nodeData.split.featureIndex", "nodeData.split.leftCategoriesOrThreshold",
        "nodeData.split.numCategories").collect()   # trees x nodes rows (model size)
    boosted = "GBT" in type(model).__name__
    by_tree: dict = {}
    for r in rows:
        by_tree.setdefault(r["treeID"], []).append(r)
    trees = []
    for tid in sorted(by_tree):
        nodes = sorted(by_tree[tid], key=lambda r: r["id"])
        n = len(nodes)
        left, right, feat = np.full(n, -1), np.full(n, -1), np.full(n, -1)
        thr, val, cov, cats = np.zeros(n), np.zeros(n), np.zeros(n), [None] * n
        for r in nodes:
            i = r["id"]
            left[i], right[i] = r["leftChild"], r["rightChild"]
            stats = list(r["impurityStats"])
            if boosted:        # regression tree: stats = [weight, sum, sum of squares]
                val[i], cov[i] = r["prediction"], stats[0]
            else:              # classification tree: class weights
                tot = sum(stats)
                val[i], cov[i] = (stats[1] / tot if tot > 0 and len(stats) > 1 else 0.0), tot
            if left[i] >= 0:
                feat[i] = r["featureIndex"]
                if r["numCategories"] is not None and r["numCategories"] >= 0:
                    cats[i] = set(r["leftCategoriesOrThreshold"])
                else:
                    thr[i] = r["leftCategoriesOrThreshold"][0]
        trees.append(Tree(left, right, feat, thr, cats, val, cov))
    weights = list(model.treeWeights) if boosted else [1.0 / len(trees)] * len(trees)
    return Ensemble(trees, weights, 2.0 if boosted else 1.0)


# ------------------------------------------------------------ TreeSHAP, vectorised over rows
def _extend(d, z, o, w, pz, po, pi):
    """Append an element; d/z are Python lists, o/w lists of row vectors."""
    depth = len(d)
    d, z, o, w = d + [pi], z + [pz], o + [po], [x.copy() for x in w] + [None]
    w[depth] = np.ones_like(po) if depth == 0 else np.zeros_like(po)
    for i in range(depth - 1, -1, -1):
        w[i + 1] = w[i + 1] + po * w[i] * (i + 1) / (depth + 1)
        w[i] = pz * w[i] * (depth - i) / (depth + 1)
    return d, z, o, w


def _unwind(d, z, o, w, k):
    depth = len(d) - 1
    ok, zk = o[k], z[k]
    nz = ok != 0
    safe_o = np.where(nz, ok, 1.0)
    nxt = w[depth].copy()
    new_w = [x.copy() for x in w[:depth]]
    for i in range(depth - 1, -1, -1):
        a = nxt * (depth + 1) / ((i + 1) * safe_o)
        b = w[i] * (depth + 1) / (zk * (depth - i)) if zk != 0 else np.zeros_like(nxt)
        new_w[i] = np.where(nz, a, b)
        nxt = np.where(nz, w[i] - a * zk * (depth - i) / (depth + 1), nxt)
    return d[:k] + d[k + 1:], z[:k] + z[k + 1:], o[:k] + o[k + 1:], new_w


def _unwound_sum(z, o, w, k):
    depth = len(z) - 1
    ok, zk = o[k], z[k]
    nz = ok != 0
    safe_o = np.where(nz, ok, 1.0)
    nxt = w[depth].copy()
    total = np.zeros_like(nxt)
    for i in range(depth - 1, -1, -1):
        a = nxt * (depth + 1) / ((i + 1) * safe_o)
        b = (w[i] / zk) / ((depth - i) / (depth + 1)) if zk != 0 else np.zeros_like(nxt)
        total = total + np.where(nz, a, b)
        nxt = np.where(nz, w[i] - a * zk * ((depth - i) / (depth + 1)), nxt)
    return total


def tree_shap(X: np.ndarray, tree: Tree, phi: np.ndarray, weight: float) -> None:
    """Add weight x SHAP values of one tree for all rows of X to phi."""
    n = X.shape[0]

    def goes_left(node):
        x = X[:, tree.feature[node]]
        if tree.categories[node] is not None:
            return np.isin(x, list(tree.categories[node])).astype(float)
        return (x <= tree.threshold[node]).astype(float)

    def recurse(node, d, z, o, w, pz, po, pi):
        d, z, o, w = _extend(d, z, o, w, pz, po, pi)
        if tree.left[node] < 0:
            for i in range(1, len(d)):
                s = _unwound_sum(z, o, w, i)
                phi[:, d[i]] += weight * s * (o[i] - z[i]) * tree.value[node]
            return
        f = tree.feature[node]
        iz, io = 1.0, np.ones(n)
        if f in d[1:]:
            k = d.index(f, 1)
            iz, io = z[k], o[k]
            d, z, o, w = _unwind(d, z, o, w, k)
        gl = goes_left(node)
        cov = tree.cover[node]
        lc, rc = tree.left[node], tree.right[node]
        recurse(lc, d, z, o, w, iz * tree.cover[lc] / cov, io * gl, f)
        recurse(rc, d, z, o, w, iz * tree.cover[rc] / cov, io * (1.0 - gl), f)

    recurse(0, [], [], [], [], 1.0, np.ones(n), -1)


def shap_values(X: np.ndarray, ens: Ensemble) -> np.ndarray:
    phi = np.zeros((X.shape[0], X.shape[1]))
    for t, w in zip(ens.trees, ens.weights):
        tree_shap(X, t, phi, w)
    return phi * ens.scale


def explain(df: DataFrame, ens: Ensemble, features: list[str], key: str) -> DataFrame:
    """Long output (key, feature, value, shap) for every row and feature."""
    feats = list(features)

    def fn(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            X = pdf[feats].to_numpy(dtype=float)
            phi = shap_values(X, ens)
            yield pd.DataFrame({key: np.repeat(pdf[key].to_numpy(), len(feats)),
                                "feature": np.tile(np.array(feats, dtype=object), len(pdf)),
                                "value": X.reshape(-1), "shap": phi.reshape(-1)})

    kt = dict(df.dtypes)[key]
    return df.select(key, *feats).mapInPandas(fn, f"{key} {kt}, feature string, value double, shap double")


def global_importance(expl: DataFrame) -> DataFrame:
    """mean |SHAP| per feature, strongest first."""
    return expl.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap")).orderBy(
        F.desc("mean_abs_shap"), "feature")
