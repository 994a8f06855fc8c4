"""Modelling (F1-F12, F14-F15) on Spark ML.

* splits and folds are functions of (seed, key): no shuffle, independent of
  partitioning, and two feature sets of the same rows stay aligned because
  the key is carried;
* the PD model is ``GeneralizedLinearRegression(binomial, logit)`` (IRLS =
  Newton for the canonical link, one distributed pass per iteration);
  coefficient inference, fit statistics, VIF and Box-Tidwell are derived
  from its summary or from one aggregate of cross-products;
* forests and boosted trees with balanced weights are grown by ``grow`` (by
  Spark ML's estimators if a feature is marked as nominal);
  the hyper-parameter search draws seeded candidates from the reference's
  ranges and fits them on stratified hash folds.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import mcfadden_grade, or_direction
from ..functions.numeric import np_round
from ..functions.pvalues import chi2_sf
from ..session import materialize
from . import grow
from .attribution import Ensemble
from .evaluation import ranking_metrics, roc_table

Z975 = 1.959963984540054


# ---------------------------------------------------------------- splits
def hash_order(key: str, seed: int) -> Column:
    """A 60-bit integer from md5(seed-key): order within class for exact
    splits; reproducible in any engine with md5."""
    d = F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))
    return F.conv(F.substring(d, 1, 15), 16, 10).cast("bigint")


def unit_hash(key: str, seed: int) -> Column:
    """xxhash64(seed, key) mapped to [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 53)).cast("double") / float(1 << 53)


RANK_BUCKETS = 4096


def _bucket(h: Column) -> Column:
    """The leading 12 of the 60 bits of ``hash_order``."""
    return F.shiftright(h, 48).cast("int")


def _bucket_counts(df: DataFrame, key: str, label: str, seed: int) -> dict:
    """class -> rows in each bucket of the hash order (classes x 4,096 rows)."""
    rows = (df.select(F.col(label).alias("y"), _bucket(hash_order(key, seed)).alias("b"))
            .groupBy("y", "b").agg(F.count(F.lit(1)).alias("n")).collect())
    out: dict = {}
    for r in rows:
        out.setdefault(r["y"], [0] * RANK_BUCKETS)[0 if r["b"] is None else r["b"]] += r["n"]
    return out


def stratified_split(df: DataFrame, key: str, label: str, test_size: float = 0.2, seed: int = 42,
                     exact: bool = True) -> DataFrame:
    """add ``is_test``.  ``exact``: per class, the first
    round(test_size * n_c) rows in md5 order go to test (class shares kept
    exactly).  Otherwise a per-row hash threshold (no shuffle at all).

    No row is sorted or moved: one aggregate counts the rows of each class in
    4,096 ranges of the hash, the rows of the one range that holds a class's
    cut are ranked, and the cut enters the plan as a literal."""
    if not exact:
        return df.withColumn("is_test", unit_hash(key, seed) < test_size)
    counts = _bucket_counts(df, key, label, seed)
    y, h = F.col(label), hash_order(key, seed)
    want, spot = {}, F.lit(False)
    for c, n in counts.items():
        left = int(round(sum(n) * test_size))   # half to even, as NumPy
        at = 0
        while at < RANK_BUCKETS and left > n[at]:
            left -= n[at]
            at += 1
        want[c] = (at, left)
        if left > 0:
            spot = spot | (y.eqNullSafe(F.lit(c)) & (_bucket(h) == at))
    order = Window.partitionBy("y").orderBy("h", "k")
    last = (df.where(spot).select(y.alias("y"), h.alias("h"), F.col(key).alias("k"))
            .withColumn("r", F.row_number().over(order)))
    hit = F.lit(False)
    for c, (_, left) in want.items():
        hit = hit | (F.col("y").eqNullSafe(F.lit(c)) & (F.col("r") == left))
    cut = {r["y"]: (r["h"], r["k"]) for r in last.where(hit).collect()}   # one row a class
    test = F.lit(False)
    for c, (at, left) in want.items():
        inside = _bucket(h) < at
        if c in cut:
            th, tk = cut[c]
            inside = inside | ((_bucket(h) == at) & ((h < th) | ((h == th) & (F.col(key) <= F.lit(tk)))))
        test = test | (y.eqNullSafe(F.lit(c)) & inside)
    return df.withColumn("is_test", F.coalesce(test, F.lit(False)))


def kfold(df: DataFrame, key: str, k: int = 5, seed: int = 42, label: str | None = None) -> DataFrame:
    """add ``fold`` (0..k-1).  With ``label``: stratified -- each class,
    in md5 order of the key, is cut into k stretches of equal size (to one
    row), so every fold holds the same class shares.  Without: the key's hash.
    Null labels are a class of their own.  Rows that share key and label stay
    in one fold (null keys count as one key), so a key with many rows makes its
    fold larger; every row gets a fold and none is dropped.

    A narrow projection, as ``stratified_split``: one aggregate counts the
    rows of each class in 4,096 ranges of the hash, only the distinct
    keys of the ranges that hold a cut are ranked (by their row counts), and the k - 1 cuts a class enter the
    plan as literals.  No wide row moves."""
    if label is None:
        return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(k)).cast("int"))
    y, h = F.col(label), F.col("__fold_h")
    hashed = df.withColumn("__fold_h", F.coalesce(hash_order(key, seed), F.lit(0)))
    want, spots = [], {}                                        # (class, fold that ends, bucket, rank inside it)
    for c, n in _bucket_counts(df, key, label, seed).items():
        total, at, before = sum(n), 0, 0
        end = 0
        for fold in range(k - 1):
            end += total // k + (1 if fold < total % k else 0)
            while at < RANK_BUCKETS and before + n[at] < end:
                before += n[at]
                at += 1
            want.append((c, fold, at, end - before))
            if end > before:
                spots.setdefault(c, set()).add(at)
    spot = F.lit(False)
    for c, buckets in spots.items():
        spot = spot | (y.eqNullSafe(F.lit(c)) & _bucket(h).isin(sorted(buckets)))
    order = Window.partitionBy("y", "b").orderBy("h", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (hashed.where(spot).groupBy(y.alias("y"), _bucket(h).alias("b"), h.alias("h"), F.col(key).alias("k"))
              .agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(order)))
    hit = F.lit(False)
    for c, _, at, left in want:
        hit = hit | (F.col("y").eqNullSafe(F.lit(c)) & (F.col("b") == at)
                     & (F.col("upto") >= left) & (F.col("upto") - F.col("n") < left))
    cuts = ranked.where(hit).collect()                          # at most k - 1 rows a class
    passed = F.lit(0)
    for c, _, at, left in want:
        inside = _bucket(h) < at
        for r in cuts:
            if r["y"] == c and r["b"] == at and r["upto"] - r["n"] < left <= r["upto"]:
                same = F.col(key).isNull()
                inside = (h < r["h"]) | ((h == r["h"]) & (same if r["k"] is None else same | (F.col(key) <= F.lit(r["k"]))))
        passed = passed + F.when(y.eqNullSafe(F.lit(c)) & ~inside, 1).otherwise(0)   # beyond the cut: a later fold
    return hashed.withColumn("fold", passed.cast("int")).drop("__fold_h")


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """n / (2 n_c) as a column; two class counts are fitted state."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    w = None
    for c, nc in counts.items():
        val = n / (len(counts) * nc)
        w = F.when(F.col(label) == c, val) if w is None else w.when(F.col(label) == c, val)
    return df.withColumn(out, w)


def scale_pos_weight(df: DataFrame, label: str) -> float:
    r = df.agg(F.sum((F.col(label) == 0).cast("bigint")).alias("neg"),
               F.sum((F.col(label) == 1).cast("bigint")).alias("pos")).first()
    return round(r["neg"] / r["pos"], 4)


# ---------------------------------------------------------------- logistic
@dataclass
class LogitFit:
    features: list[str]
    coef: list[float]
    intercept: float
    se: list[float]          # features..., intercept (Spark order)
    pvalues: list[float]
    deviance: float
    null_deviance: float
    aic: float
    n: int
    model: object

    def coefficient_rows(self) -> list[tuple]:
        names = ["const"] + self.features
        b = [self.intercept] + self.coef
        se = [self.se[-1]] + self.se[:-1]
        p = [self.pvalues[-1]] + self.pvalues[:-1]
        return [(nm, float(bb), float(s), float(bb / s) if s else None, float(pp)) for nm, bb, s, pp in zip(names, b, se, p)]

    def log_odds(self) -> Column:
        expr = F.lit(self.intercept)
        for f, b in zip(self.features, self.coef):
            expr = expr + F.lit(b) * F.col(f)
        return expr


def fit_logit(df: DataFrame, features: list[str], label: str, max_iter: int = 100, weight: str | None = None) -> LogitFit:
    """binomial GLM with logit link by IRLS on rows with all inputs present."""
    data = df.na.drop(subset=features + [label])
    va = VectorAssembler(inputCols=features, outputCol="_x")
    glr = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="_x", labelCol=label,
                                      maxIter=max_iter, regParam=0.0, fitIntercept=True)
    if weight:
        glr.setWeightCol(weight)
    # IRLS makes one pass per iteration: cache the assembled rows once
    cols = [*features, label, *([weight] if weight else [])]
    assembled = va.transform(data.select(*cols)).persist()
    m = glr.fit(assembled)
    s = m.summary
    se, pv = list(s.coefficientStandardErrors), list(s.pValues)   # from the last IRLS solve, no extra pass
    # deviances and n in one aggregate instead of one summary job each
    lin = F.lit(float(m.intercept))
    for f, b in zip(features, m.coefficients):
        lin = lin + F.lit(float(b)) * F.col(f)
    y = F.col(label).cast("double")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-lin))
    eps = 1e-300
    r = assembled.agg(
        F.sum(w * (y * F.ln(F.greatest(p, F.lit(eps))) + (1 - y) * F.ln(F.greatest(1 - p, F.lit(eps))))).alias("llf"),
        F.sum(w * y).alias("sy"), F.sum(w).alias("sw"), F.count(F.lit(1)).alias("n")).first()
    ybar = r["sy"] / r["sw"]
    llnull = r["sy"] * math.log(ybar) + (r["sw"] - r["sy"]) * math.log(1 - ybar) if 0 < ybar < 1 else 0.0
    k = len(features) + 1
    deviance, null_deviance = -2.0 * r["llf"], -2.0 * llnull
    fit = LogitFit(list(features), [float(v) for v in m.coefficients], float(m.intercept), se, pv,
                   deviance, null_deviance, deviance + 2 * k, int(r["n"]), m)
    assembled.unpersist()
    return fit


def term_label(term: Column) -> Column:
    """A readable term: without ``_woe``, blanks for underscores, each
    word with a capital."""
    return F.initcap(F.replace(F.replace(term, F.lit("_woe"), F.lit("")), F.lit("_"), F.lit(" ")))


def coefficient_table(spark, fit: LogitFit, alpha: float = 0.05) -> DataFrame:
    """(term, label, beta, se, z, p_value, ci_lower, ci_upper, odds_ratio,
    or_ci_lower, or_ci_upper, significant, direction), sorted by p."""
    df = spark.createDataFrame(fit.coefficient_rows(), "term string, beta double, se double, z double, p_value double")
    lo, hi = F.col("beta") - Z975 * F.col("se"), F.col("beta") + Z975 * F.col("se")
    return df.select("term", term_label(F.col("term")).alias("label"), np_round("beta", 4).alias("beta"), np_round("se", 4).alias("se"),
                     np_round("z", 4).alias("z"), np_round("p_value", 4).alias("p_value"),
                     np_round(lo, 4).alias("ci_lower"), np_round(hi, 4).alias("ci_upper"),
                     np_round(F.exp("beta"), 4).alias("odds_ratio"), np_round(F.exp(lo), 4).alias("or_ci_lower"),
                     np_round(F.exp(hi), 4).alias("or_ci_upper"), (F.col("p_value") < alpha).alias("significant"),
                     or_direction(F.exp("beta")).alias("direction")).orderBy("p_value", "term")


def fit_statistics(spark, fit: LogitFit) -> DataFrame:
    """llf, llnull, McFadden R2 and its grade, AIC, BIC, LLR and its p-value."""
    k = len(fit.features) + 1
    llf, lln = -fit.deviance / 2.0, -fit.null_deviance / 2.0
    llr = fit.null_deviance - fit.deviance
    row = [(fit.n, k, llf, lln, 1 - llf / lln if lln else None, fit.deviance + 2 * k,
            fit.deviance + k * math.log(fit.n), llr, k - 1)]
    df = spark.createDataFrame(row, "n bigint, k bigint, llf double, llnull double, mcfadden_r2 double, "
                                    "aic double, bic double, llr double, llr_dof bigint")
    return df.select("*", chi2_sf(F.col("llr"), F.col("llr_dof")).alias("llr_p_value"),
                     mcfadden_grade(F.col("mcfadden_r2")).alias("grade"))


def predict_pd(df: DataFrame, fit: LogitFit, out: str = "pd") -> DataFrame:
    """sigmoid of the linear predictor as a column expression."""
    return df.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-fit.log_odds())))


def _gram(data: DataFrame, cols: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """(X'X, column sums, n) in one distributed pass for any number of
    columns: each row gives its products inside the stage, the partial
    aggregate keyed by (i, j) keeps k^2 / 2 rows a task; the k x k result is
    collected (k = number of model features)."""
    k = len(cols)
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in cols])
    long = (data.select(x.alias("x")).select("x", F.explode(F.sequence(F.lit(0), F.lit(k))).alias("i"))
            .select("x", "i", F.explode(F.sequence(F.col("i"), F.lit(k))).alias("j")))
    got = long.groupBy("i", "j").agg(F.sum(F.get("x", F.col("i")) * F.get("x", F.col("j"))).alias("s")).collect()
    g = np.zeros((k + 1, k + 1))
    for r in got:
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["s"]
    return g[1:, 1:], g[0, 1:], int(g[0, 0])


def vif(df: DataFrame, cols: list[str], centered: bool = False) -> DataFrame:
    """VIF of each column against the others, uncentered by default
    (no constant).  One distributed pass builds the k x k cross-product
    matrix; it is inverted on the driver (k = number of model features)."""
    data = df.na.drop(subset=cols)
    g, s, n = _gram(data, cols)
    if centered:
        g = g - np.outer(s, s) / n
    inv = np.linalg.pinv(g)
    vals = [(c, float(g[i, i] * inv[i, i])) for i, c in enumerate(cols)]
    out = df.sparkSession.createDataFrame(vals, "feature string, vif double")
    from ..functions.labels import vif_status
    return out.select("feature", np_round("vif", 4).alias("vif"), vif_status(F.col("vif")).alias("status"))


def box_tidwell(df: DataFrame, numeric_cols: list[str], label: str, clip_lower: float = 0.01) -> DataFrame:
    """logit on clipped x and x ln x; linearity is violated when the
    x ln x term has p < 0.05."""
    cols, terms = [], []
    for c in numeric_cols:
        x = F.greatest(F.col(c).cast("double"), F.lit(clip_lower))
        cols += [x.alias(c), (x * F.ln(x)).alias(f"{c}_xlnx")]
        terms.append(f"{c}_xlnx")
    data = df.select(F.col(label), *cols)
    fit = fit_logit(data, [c for c in numeric_cols] + terms, label)
    rows = {nm: p for nm, _, _, _, p in fit.coefficient_rows()}
    out = df.sparkSession.createDataFrame([(c, float(rows[f"{c}_xlnx"])) for c in numeric_cols],
                                          "feature string, p_value double")
    return out.select("feature", np_round("p_value", 4).alias("p_value"),
                      (F.col("p_value") < 0.05).alias("violated"))


# ---------------------------------------------------------------- trees
def _assemble(df, features):
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df)


def class_weights(df: DataFrame, label: str) -> dict:
    """class -> n / (classes x n_c)."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    return {c: sum(counts.values()) / (len(counts) * n) for c, n in counts.items()}


def _nominal(df: DataFrame, features: list[str]) -> bool:
    """Features with the levels of a nominal attribute split by category, as
    Spark ML's estimators do."""
    return any("vals" in df.schema[f].metadata.get("ml_attr", {}) for f in features)


def fit_forest(df: DataFrame, features: list[str], label: str, num_trees: int = 200, max_depth: int = 8,
               min_leaf: int = 2, seed: int = 42):
    """F8: balanced class weights, sqrt feature subsets."""
    if not _nominal(df, features):
        edges = grow.bin_edges(df, features)
        blocks = grow.binned(df, features, label, edges)
        model, = grow.forest(blocks, edges, class_weights(df, label), [-1], num_trees, max_depth, min_leaf, "sqrt", seed)
        blocks.unpersist()
        return model
    data = _assemble(balanced_weights(df, label), features)
    rf = RandomForestClassifier(labelCol=label, featuresCol="features", weightCol="weight", numTrees=num_trees,
                                maxDepth=max_depth, minInstancesPerNode=min_leaf, featureSubsetStrategy="sqrt",
                                seed=seed)
    return rf.fit(data)


def fit_boosted(df: DataFrame, features: list[str], label: str, rounds: int = 200, max_depth: int = 5,
                step: float = 0.05, subsample: float = 0.8, min_child: int = 5, seed: int = 42):
    """positive class weighted by n_neg / n_pos."""
    spw = scale_pos_weight(df, label)
    if not _nominal(df, features):
        edges = grow.bin_edges(df, features)
        blocks = grow.binned(df, features, label, edges)
        model = grow.boosted(df.sparkSession, blocks, edges, {0: 1.0, 1: spw}, -1, rounds, max_depth, step, subsample, min_child, seed)
        blocks.unpersist()
        return model
    data = _assemble(df.withColumn("weight", F.when(F.col(label) == 1, spw).otherwise(1.0)), features)
    gbt = GBTClassifier(labelCol=label, featuresCol="features", weightCol="weight", maxIter=rounds, maxDepth=max_depth,
                        stepSize=step, subsamplingRate=subsample, minInstancesPerNode=min_child, seed=seed)
    return gbt.fit(data)


def positive_prob(model, df: DataFrame, features: list[str], out: str = "pd") -> DataFrame:
    if isinstance(model, Ensemble):
        return df.withColumn(out, grow.probability({-1: model}, features))
    from pyspark.ml.functions import vector_to_array
    scored = model.transform(_assemble(df, features))
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("features", "rawPrediction",
                                                                         "probability", "prediction")


# Search ranges of the reference workflow (inclusive).
FOREST_SPACE = {"numTrees": ("int", 50, 400), "maxDepth": ("int", 3, 15), "minInstancesPerNode": ("int", 1, 10),
                "featureSubsetStrategy": ("choice", ["sqrt", "log2", "all"])}
BOOST_SPACE = {"maxIter": ("int", 50, 500), "maxDepth": ("int", 3, 10), "stepSize": ("log", 0.01, 0.30),
               "subsamplingRate": ("float", 0.5, 1.0), "minInstancesPerNode": ("int", 1, 20)}


def draw_params(space: dict, rng: random.Random) -> dict:
    out = {}
    for name, spec in space.items():
        kind = spec[0]
        if kind == "int":
            out[name] = rng.randint(spec[1], spec[2])
        elif kind == "float":
            out[name] = rng.uniform(spec[1], spec[2])
        elif kind == "log":
            out[name] = math.exp(rng.uniform(math.log(spec[1]), math.log(spec[2])))
        else:
            out[name] = rng.choice(spec[1])
    return out


def cv_search(df: DataFrame, features: list[str], label: str, key: str, n_trials: int = 50, k: int = 5,
              seed: int = 42, parallelism: int = 4, kind: str = "forest", space: dict | None = None):
    """seeded random draws from the search space (default: the
    reference's ranges for the model kind), stratified k-fold CV, AUC
    maximised.  Returns (best model, [(params, auc)])."""
    rng = random.Random(seed)
    space = space or (FOREST_SPACE if kind == "forest" else BOOST_SPACE)
    ev = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="__p", metricName="areaUnderROC",
                                       numBins=0)   # exact AUC, no score down-sampling
    trials = [draw_params(space, rng) for _ in range(n_trials)]
    if not _nominal(df, features):
        return _grown_search(df, features, label, key, trials, k, seed, parallelism, kind, ev)
    ev = ev.setRawPredictionCol("rawPrediction")
    est = (RandomForestClassifier(labelCol=label, featuresCol="features", weightCol="weight", seed=seed)
           if kind == "forest" else
           GBTClassifier(labelCol=label, featuresCol="features", weightCol="weight", seed=seed))
    maps = [{est.getParam(name): v for name, v in p.items()} for p in trials]
    data = _assemble(kfold(balanced_weights(df, label), key, k, seed, label=label), features)
    cv = CrossValidator(estimator=est, estimatorParamMaps=maps or ParamGridBuilder().build(), evaluator=ev,
                        foldCol="fold", numFolds=k, parallelism=parallelism, seed=seed)
    cvm = cv.fit(data)
    results = [({p.name: v for p, v in m.items()}, float(a)) for m, a in zip(maps, cvm.avgMetrics)]
    return cvm.bestModel, results


def _grown_search(df, features, label, key, trials, k, seed, parallelism, kind, evaluator):
    """The trials of ``cv_search`` on rows that are binned once."""
    spark = df.sparkSession
    folded = materialize(spark, kfold(df, key, k, seed, label=label).select(*features, label, "fold"), "folds")
    edges, weights = grow.bin_edges(folded, features), class_weights(folded, label)
    blocks = grow.binned(folded, features, label, edges, "fold")

    def boosted(params, fold):
        return grow.boosted(spark, blocks, edges, weights, fold, params.get("maxIter", 20), params.get("maxDepth", 5), params.get("stepSize", 0.1),
                            params.get("subsamplingRate", 1.0), params.get("minInstancesPerNode", 1), seed)

    def auc(params):
        found = []
        for fold in range(k):
            held = folded.where(F.col("fold") == fold).withColumn("__p", grow.probability({-1: boosted(params, fold)}, features)).select("__p", label)
            held = held.persist()
            found.append(evaluator.evaluate(held))
            held.unpersist()
        return sum(found) / k

    forests = [(p.get("numTrees", 20), p.get("maxDepth", 5), p.get("minInstancesPerNode", 1), p.get("featureSubsetStrategy", "sqrt")) for p in trials]
    if kind == "forest":
        of = _forest_aucs(folded, label, blocks, edges, weights, forests, k, seed)
        results = [(p, sum(of[i, fold] for fold in range(k)) / k) for i, p in enumerate(trials)]
    else:
        with ThreadPool(max(1, min(parallelism, len(trials)))) as pool:
            results = list(zip(trials, pool.map(inheritable_thread_target(spark)(auc), trials, chunksize=1)))
    best = max(range(len(trials)), key=lambda i: results[i][1])
    model = grow.forest(blocks, edges, weights, [-1], *forests[best], seed)[0] if kind == "forest" else boosted(trials[best], -1)
    blocks.unpersist()
    return model, results


def _forest_aucs(folded, label, blocks, edges, weights, forests, k, seed):
    """(trial, fold) -> exact AUC on the fold's rows of the forest of the others."""
    counts = {(r["fold"], r[label]): r["n"] for r in folded.groupBy("fold", label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(counts.values()) * (len(edges) + 2) <= grow.LOCAL_BYTES:
        return grow.search_here(blocks, edges, weights, forests, k, seed)
    both = [f for f in range(k) if counts.get((f, 0)) and counts.get((f, 1))]
    out = {(i, f): float(counts.get((f, 1), 0) > 0) for i in range(len(forests)) for f in range(k)}   # of a fold with one class
    for scores in grow.search_scores(blocks, edges, weights, forests, k, seed):
        roc = roc_table(scores.where(F.col("fold").isin(both)), "score", "y", ["trial", "fold"])
        out |= {(r["trial"], r["fold"]): r["auc"] for r in ranking_metrics(roc, ["trial", "fold"]).collect()}
    return out


# ---------------------------------------------------------------- attribution
def linear_attribution(df: DataFrame, fit: LogitFit, key: str) -> DataFrame:
    """F14 (linear model): exact per-row contributions b_i (x_i - mean_i)
    in long form (key, feature, contribution).  Means are one aggregate."""
    means = df.agg(*[F.avg(f).alias(f) for f in fit.features]).first()
    parts = [F.struct(F.lit(f).alias("feature"), (F.lit(b) * (F.col(f) - F.lit(float(means[f])))).alias("contribution"))
             for f, b in zip(fit.features, fit.coef)]
    return df.select(F.col(key), F.explode(F.array(*parts)).alias("c")).select(key, "c.feature", "c.contribution")


def global_importance(contrib: DataFrame) -> DataFrame:
    return contrib.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs")).orderBy(F.desc("mean_abs"))


def highest_risk(df: DataFrame, score: str, key: str) -> DataFrame:
    """the row with the largest score (ties: smallest key)."""
    return df.orderBy(F.desc(score), F.col(key)).limit(1)
