"""F: splits, the logistic PD model and its diagnostics, tree models,
hyper-parameter search and attribution (rows-only checks except the split)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import models as md
from ..operators import woe
from ..sources.loan_book import CATEGORICAL_FEATURES, NUMERIC_FEATURES, loan_book
from .registry import query
from .sql_parts import with_loan_book

NUM, CAT = NUMERIC_FEATURES, CATEGORICAL_FEATURES
SEED = 42


@query("stratified_split", with_loan_book(f"""
, h AS (SELECT loan_id, target, ('0x' || substr(md5('{SEED}-' || CAST(loan_id AS VARCHAR)), 1, 15))::BIGINT AS hh FROM loan_book)
, r AS (SELECT loan_id, target, row_number() OVER (PARTITION BY target ORDER BY hh, loan_id) AS rn,
               COUNT(*) OVER (PARTITION BY target) AS nc FROM h)
SELECT loan_id, target, rn <= round_even(nc * 0.2, 0) AS is_test FROM r"""))
def stratified_split_q(spark, sf_dir):
    """F1 exact: per class, the first round(0.2 n_c) rows in md5 order."""
    return md.stratified_split(loan_book(spark, sf_dir).select("loan_id", "target"), "loan_id", "target", 0.2, SEED)


def _woe_split(spark, sf_dir):
    """WoE on all rows (as the reference does), selected features, split."""
    book = loan_book(spark, sf_dir, materialize=True)
    m = woe.fit_woe(book, "target", NUM, CAT)
    feats = woe.selected_features(woe.iv_summary(m), 0.02)
    enc = woe.encode(book, m, feats, keep=["loan_id", "target", "pd", "credit_amount"])
    split = md.stratified_split(enc, "loan_id", "target", 0.2, SEED)
    return split, [f + "_woe" for f in feats]


def _raw_split(spark, sf_dir):
    """The same split of the rows with raw features, as the tree models use
    them: numerics as they are, categoricals as codes in alphabetical order
    (levels not seen in training share one further code)."""
    from pyspark.ml.feature import StringIndexer

    split = md.stratified_split(loan_book(spark, sf_dir, materialize=True), "loan_id", "target", 0.2, SEED)
    codes = [f"{c}_code" for c in CAT]
    index = StringIndexer(inputCols=CAT, outputCols=codes, handleInvalid="keep", stringOrderType="alphabetAsc")
    coded = index.fit(split.where(~F.col("is_test"))).transform(split)
    raw = coded.select("loan_id", "target", "is_test", *NUM, *[F.col(c).alias(c, metadata={}) for c in codes])
    return raw, NUM + codes


@query("kfold_balance", with_loan_book(f"""
, h AS (SELECT loan_id, target, ('0x' || substr(md5('{SEED}-' || CAST(loan_id AS VARCHAR)), 1, 15))::BIGINT AS hh FROM loan_book)
, r AS (SELECT target, CAST((row_number() OVER (PARTITION BY target ORDER BY hh, loan_id) - 1) % 5 AS INTEGER) AS fold FROM h)
SELECT fold, CAST(COUNT(*) AS BIGINT) AS n, AVG(CAST(target AS DOUBLE)) AS default_rate FROM r GROUP BY fold"""))
def kfold_balance_q(spark, sf_dir):
    """stratified 5-fold assignment; rows and default rate per fold."""
    k = md.kfold(loan_book(spark, sf_dir).select("loan_id", "target"), "loan_id", 5, SEED, label="target")
    return k.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("target").cast("double")).alias("default_rate"))


@query("logit_coefficients")
def logit_coefficients_q(spark, sf_dir):
    """IRLS logit on the training rows' WoE columns."""
    split, cols = _woe_split(spark, sf_dir)
    fit = md.fit_logit(split.where(~F.col("is_test")), cols, "target")
    return md.coefficient_table(spark, fit)


@query("fit_statistics")
def fit_statistics_q(spark, sf_dir):
    """F4."""
    split, cols = _woe_split(spark, sf_dir)
    return md.fit_statistics(spark, md.fit_logit(split.where(~F.col("is_test")), cols, "target"))


@query("vif")
def vif_q(spark, sf_dir):
    """uncentered VIF of the model's WoE columns."""
    split, cols = _woe_split(spark, sf_dir)
    return md.vif(split, cols)


@query("box_tidwell")
def box_tidwell_q(spark, sf_dir):
    """F7 on the raw numeric features."""
    book = loan_book(spark, sf_dir, materialize=True)
    return md.box_tidwell(book, NUM, "target")


@query("logit_test_metrics")
def logit_test_metrics_q(spark, sf_dir):
    """F5 + G11: PD of the fitted logit on the hold-out rows, full metrics."""
    split, cols = _woe_split(spark, sf_dir)
    fit = md.fit_logit(split.where(~F.col("is_test")), cols, "target")
    test = md.predict_pd(split.where(F.col("is_test")), fit, "p")
    return ev.all_metrics(test.withColumn("model", F.lit("logistic")), "p", "target", 0.5, ["model"])


def _tree_metrics(spark, sf_dir, kind):
    split, cols = _raw_split(spark, sf_dir)
    train, test = split.where(~F.col("is_test")), split.where(F.col("is_test"))
    model = md.fit_forest(train, cols, "target") if kind == "forest" else md.fit_boosted(train, cols, "target")
    scored = md.positive_prob(model, test, cols, "p").withColumn("model", F.lit(kind))
    return ev.all_metrics(scored, "p", "target", 0.5, ["model"])


@query("forest_pd")
def forest_pd_q(spark, sf_dir):
    """F8: random forest (200 trees, depth 8, leaf 2, sqrt, balanced)."""
    return _tree_metrics(spark, sf_dir, "forest")


@query("boosted_pd")
def boosted_pd_q(spark, sf_dir):
    """boosted trees (200 rounds, depth 5, step .05, subsample .8)."""
    return _tree_metrics(spark, sf_dir, "boosted")


@query("cv_search")
def cv_search_q(spark, sf_dir):
    """seeded random search over the forest space, 5-fold CV AUC, with
    the reference's 50 trials."""
    split, cols = _raw_split(spark, sf_dir)
    _, results = md.cv_search(split.where(~F.col("is_test")), cols, "target", "loan_id", n_trials=50, k=5, parallelism=8)
    rows = [(str(sorted(p.items())), float(a)) for p, a in results]
    return spark.createDataFrame(rows, "params string, cv_auc double").orderBy(F.desc("cv_auc"))


@query("attribution")
def attribution_q(spark, sf_dir):
    """F14 (linear): mean |b_i (x_i - mean_i)| per feature over all rows."""
    split, cols = _woe_split(spark, sf_dir)
    fit = md.fit_logit(split.where(~F.col("is_test")), cols, "target")
    return md.global_importance(md.linear_attribution(split, fit, "loan_id"))


@query("highest_risk", with_loan_book("""
SELECT loan_id, pd_fine, credit_amount, priority FROM loan_book ORDER BY pd_fine DESC, loan_id LIMIT 1"""))
def highest_risk_q(spark, sf_dir):
    """F15."""
    return md.highest_risk(loan_book(spark, sf_dir).select("loan_id", "pd_fine", "credit_amount", "priority"),
                           "pd_fine", "loan_id")


def _boosted_explanations(spark, sf_dir):
    from ..operators import attribution as A
    from ..session import ensure_checkpoint_dir

    split, cols = _raw_split(spark, sf_dir)
    train, test = split.where(~F.col("is_test")), split.where(F.col("is_test"))
    model = md.fit_boosted(train, cols, "target")
    ens = A.ensemble_from_model(model, ensure_checkpoint_dir(spark))
    return A, ens, test, model, cols


@query("tree_attribution")
def tree_attribution_q(spark, sf_dir):
    """TreeSHAP of the boosted model on the hold-out rows; mean |SHAP|
    per feature (log-odds units)."""
    A, ens, test, _, cols = _boosted_explanations(spark, sf_dir)
    return A.global_importance(A.explain(test, ens, cols, "loan_id"))


@query("risk_row_explanation")
def risk_row_explanation_q(spark, sf_dir):
    """the hold-out applicant with the highest boosted PD and the
    signed SHAP value of each feature."""
    A, ens, test, model, cols = _boosted_explanations(spark, sf_dir)
    scored = md.positive_prob(model, test, cols, "p")
    top = md.highest_risk(scored.select("loan_id", "p", *cols), "p", "loan_id")   # one row, explained alone
    return A.explain(top, ens, cols, "loan_id").join(top.select("loan_id", "p"), "loan_id").select("loan_id", "p", "feature", "value", "shap",
                                            F.lit(ens.expected_value()).alias("expected_value"))


@query("fitted_model_comparison")
def fitted_model_comparison_q(spark, sf_dir):
    """G12 on fitted models: logistic, random forest and boosted trees are
    fitted on the same training rows; their hold-out scores are stacked with
    a ``model`` key and evaluated in one job, best AUC first."""
    split, cols = _woe_split(spark, sf_dir)
    train, test = split.where(~F.col("is_test")), split.where(F.col("is_test"))
    logit = md.fit_logit(train, cols, "target")
    parts = [md.predict_pd(test, logit, "p").select("loan_id", "target", "p", F.lit("logistic").alias("model"))]
    raw, raw_cols = _raw_split(spark, sf_dir)
    raw_train, raw_test = raw.where(~F.col("is_test")), raw.where(F.col("is_test"))
    for name, model in (("random_forest", md.fit_forest(raw_train, raw_cols, "target")),
                        ("boosted_trees", md.fit_boosted(raw_train, raw_cols, "target"))):
        parts.append(md.positive_prob(model, raw_test, raw_cols, "p").select("loan_id", "target", "p",
                                                                   F.lit(name).alias("model")))
    stacked = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return ev.model_comparison(ev.all_metrics(stacked, "p", "target", 0.5, ["model"]))
