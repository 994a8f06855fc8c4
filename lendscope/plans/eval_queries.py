"""G and F13: evaluation of fixed PD scores on the loan book.

Two score columns are evaluated side by side as two "models" in one job:
``pd`` (heavily tied) and ``pd_fine`` (nearly untied)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import sql_ks_grade
from ..functions.pvalues import sql_chi2_sf
from ..operators import evaluation as ev
from ..operators.threshold import arange_grid, optimal_threshold, threshold_curve
from ..sources.loan_book import loan_book
from .registry import query
from .sql_parts import probs_list, with_loan_book

MODELS = ["pd", "pd_fine"]


def models_long(spark, sf_dir):
    book = loan_book(spark, sf_dir).select("loan_id", "target", *MODELS)
    return book.unpivot(["loan_id", "target"], MODELS, "model", "score")


ML_SQL = """
, ml AS (SELECT 'pd' AS model, loan_id, pd AS score, target FROM loan_book
         UNION ALL SELECT 'pd_fine' AS model, loan_id, pd_fine AS score, target FROM loan_book)
"""
ROC_SQL = ML_SQL + """
, sc AS (SELECT model, score, SUM(CASE WHEN target = 1 THEN 1 ELSE 0 END) AS pos,
                SUM(CASE WHEN target = 0 THEN 1 ELSE 0 END) AS neg FROM ml WHERE score IS NOT NULL GROUP BY model, score)
, roc AS (SELECT model, score AS threshold, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg,
                 CAST(SUM(pos) OVER (PARTITION BY model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS tp,
                 CAST(SUM(neg) OVER (PARTITION BY model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS fp,
                 CAST(SUM(pos) OVER (PARTITION BY model) AS BIGINT) AS P, CAST(SUM(neg) OVER (PARTITION BY model) AS BIGINT) AS N
          FROM sc)
, rk AS (SELECT model, SUM(neg * (tp * 2 - pos)) / (CAST(MIN(P) AS DOUBLE) * MIN(N) * 2) AS auc,
                greatest(MAX(CAST(tp AS DOUBLE) / P - CAST(fp AS DOUBLE) / N), 0.0) AS ks,
                SUM(CAST(pos AS DOUBLE) / P * (CAST(tp AS DOUBLE) / (tp + fp))) AS ap FROM roc GROUP BY model)
"""
PT_SQL = """
, pt AS (SELECT model, AVG((score - target) * (score - target)) AS brier,
                AVG(-(target * ln(least(greatest(score, 2.220446049250313e-16), 1 - 2.220446049250313e-16))
                    + (1 - target) * ln(1 - least(greatest(score, 2.220446049250313e-16), 1 - 2.220446049250313e-16)))) AS log_loss,
                CAST(SUM(CASE WHEN score >= 0.5 AND target = 1 THEN 1 ELSE 0 END) AS BIGINT) AS TP,
                CAST(SUM(CASE WHEN score < 0.5 AND target = 0 THEN 1 ELSE 0 END) AS BIGINT) AS TN,
                CAST(SUM(CASE WHEN score >= 0.5 AND target = 0 THEN 1 ELSE 0 END) AS BIGINT) AS FP,
                CAST(SUM(CASE WHEN score < 0.5 AND target = 1 THEN 1 ELSE 0 END) AS BIGINT) AS FN
         FROM ml WHERE score IS NOT NULL GROUP BY model)
"""
METRICS_SQL = ROC_SQL + PT_SQL + """
, mt AS (SELECT rk.model, ROUNDX(auc, 4) AS roc_auc, ROUNDX(ks, 4) AS ks_statistic, ROUNDX(ROUNDX(auc * 2 - 1, 4), 4) AS gini,
                ROUNDX(ap, 4) AS pr_auc, ROUNDX(brier, 4) AS brier_score, ROUNDX(log_loss, 4) AS log_loss,
                ROUNDX(CASE WHEN TP * 2 + FP + FN > 0 THEN TP * 2.0 / (TP * 2 + FP + FN) ELSE 0 END, 4) AS f1_score,
                CAST(0.5 AS DOUBLE) AS threshold, TP, TN, FP, FN,
                ROUNDX(CASE WHEN TP + FP > 0 THEN CAST(TP AS DOUBLE) / (TP + FP) ELSE 0 END, 4) AS precision,
                ROUNDX(CASE WHEN TP + FN > 0 THEN CAST(TP AS DOUBLE) / (TP + FN) ELSE 0 END, 4) AS recall
         FROM rk JOIN pt ON rk.model = pt.model)
"""


@query("roc_curve", with_loan_book(ROC_SQL + """
SELECT model, threshold, tp, fp, CAST(fp AS DOUBLE) / N AS fpr, CAST(tp AS DOUBLE) / P AS tpr FROM roc"""))
def roc_curve_q(spark, sf_dir):
    """G1: true and false positive rates at every distinct score of both PD columns."""
    return ev.roc_table(models_long(spark, sf_dir), "score", "target", ["model"]).select(
        "model", "threshold", "tp", "fp", "fpr", "tpr")


@query("pr_curve", with_loan_book(ROC_SQL + """
SELECT model, threshold, CAST(tp AS DOUBLE) / (tp + fp) AS precision, CAST(tp AS DOUBLE) / P AS recall FROM roc"""))
def pr_curve_q(spark, sf_dir):
    """Precision and recall at every distinct threshold."""
    r = ev.roc_table(models_long(spark, sf_dir), "score", "target", ["model"])
    return r.select("model", "threshold", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                    (F.col("tp") / F.col("P")).alias("recall"))


@query("auc_ks_gini", with_loan_book(ROC_SQL + f"""
SELECT model, ROUNDX(auc, 4) AS roc_auc, ROUNDX(ks, 4) AS ks_statistic, ROUNDX(auc * 2 - 1, 4) AS gini,
       {sql_ks_grade('ks')} AS ks_grade FROM rk"""))
def auc_ks_gini_q(spark, sf_dir):
    """ROC-AUC, KS (one-sided) and Gini with KS grade for both PD columns."""
    return ev.auc_ks_gini(models_long(spark, sf_dir), "score", "target", ["model"])


@query("average_precision", with_loan_book(ROC_SQL + """
SELECT model, ROUNDX(ap, 4) AS pr_auc FROM rk"""))
def average_precision_q(spark, sf_dir):
    """Average precision as a step sum over distinct thresholds."""
    r = ev.ranking_metrics(ev.roc_table(models_long(spark, sf_dir), "score", "target", ["model"]), ["model"])
    return r.select("model", ev.np_round("ap", 4).alias("pr_auc"))


@query("brier_logloss", with_loan_book(ML_SQL + PT_SQL + """
SELECT model, ROUNDX(brier, 4) AS brier_score, ROUNDX(log_loss, 4) AS log_loss FROM pt"""))
def brier_logloss_q(spark, sf_dir):
    """Brier score and log loss for both PD columns."""
    p = ev.pointwise_metrics(models_long(spark, sf_dir), "score", "target", 0.5, ["model"])
    return p.select("model", ev.np_round("brier", 4).alias("brier_score"), ev.np_round("log_loss", 4).alias("log_loss"))


@query("model_metrics", with_loan_book(METRICS_SQL + "SELECT * FROM mt"))
def model_metrics_q(spark, sf_dir):
    """The full metric row for both PD columns at threshold 0.5."""
    return ev.all_metrics(models_long(spark, sf_dir), "score", "target", 0.5, ["model"])


@query("model_comparison", with_loan_book(METRICS_SQL + """
SELECT model, roc_auc, ks_statistic, gini, pr_auc, brier_score, f1_score FROM mt"""))
def model_comparison_q(spark, sf_dir):
    """Metric table of both PD columns, best AUC first."""
    return ev.model_comparison(ev.all_metrics(models_long(spark, sf_dir), "score", "target", 0.5, ["model"]))


@query("normalized_metrics", with_loan_book(METRICS_SQL + """
, lg AS (SELECT model, 'roc_auc' AS metric, CAST(roc_auc AS DOUBLE) AS value FROM mt
         UNION ALL SELECT model, 'ks_statistic', ks_statistic FROM mt UNION ALL SELECT model, 'gini', gini FROM mt
         UNION ALL SELECT model, 'pr_auc', pr_auc FROM mt UNION ALL SELECT model, 'f1_score', f1_score FROM mt)
SELECT model, metric, value, (value - MIN(value) OVER (PARTITION BY metric))
       / (MAX(value) OVER (PARTITION BY metric) - MIN(value) OVER (PARTITION BY metric) + 1e-9) AS normalized FROM lg"""))
def normalized_metrics_q(spark, sf_dir):
    """Metrics min-max normalised across models."""
    return ev.normalized_metrics(ev.all_metrics(models_long(spark, sf_dir), "score", "target", 0.5, ["model"]))


@query("confusion_report", with_loan_book(ML_SQL + PT_SQL + """
, c AS (SELECT model, CAST(TP AS DOUBLE) AS tp, CAST(TN AS DOUBLE) AS tn, CAST(FP AS DOUBLE) AS fp, CAST(FN AS DOUBLE) AS fn FROM pt)
, pr AS (SELECT model, CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0 END AS p0, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS r0,
                CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p1, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r1,
                tn + fp AS s0, tp + fn AS s1 FROM c)
, f AS (SELECT *, CASE WHEN p0 + r0 > 0 THEN p0 * r0 * 2 / (p0 + r0) ELSE 0 END AS f0,
               CASE WHEN p1 + r1 > 0 THEN p1 * r1 * 2 / (p1 + r1) ELSE 0 END AS f1 FROM pr)
SELECT model, '0' AS class, ROUNDX(p0, 4) AS precision, ROUNDX(r0, 4) AS recall, ROUNDX(f0, 4) AS f1, CAST(s0 AS BIGINT) AS support FROM f
UNION ALL SELECT model, '1', ROUNDX(p1, 4), ROUNDX(r1, 4), ROUNDX(f1, 4), CAST(s1 AS BIGINT) FROM f
UNION ALL SELECT model, 'macro avg', ROUNDX((p0 + p1) / 2, 4), ROUNDX((r0 + r1) / 2, 4), ROUNDX((f0 + f1) / 2, 4), CAST(s0 + s1 AS BIGINT) FROM f
UNION ALL SELECT model, 'weighted avg', ROUNDX((p0 * s0 + p1 * s1) / (s0 + s1), 4), ROUNDX((r0 * s0 + r1 * s1) / (s0 + s1), 4),
                 ROUNDX((f0 * s0 + f1 * s1) / (s0 + s1), 4), CAST(s0 + s1 AS BIGINT) FROM f"""))
def confusion_report_q(spark, sf_dir):
    """Per-class precision, recall, F1 and support, macro and weighted averages."""
    return ev.classification_report(models_long(spark, sf_dir), "score", "target", 0.5, ["model"])


_cal_edges = [i * 0.1 for i in range(1, 10)]
_cal_case = "CASE " + " ".join(f"WHEN score <= {e!r} THEN {i}" for i, e in enumerate(_cal_edges)) + " ELSE 9 END"


@query("calibration", with_loan_book(ML_SQL + f"""
SELECT model, {_cal_case} AS bin, ROUNDX(AVG(score), 6) AS mean_pred, AVG(CAST(target AS DOUBLE)) AS frac_pos, CAST(COUNT(*) AS BIGINT) AS n
FROM ml WHERE score IS NOT NULL GROUP BY model, {_cal_case}"""))
def calibration_q(spark, sf_dir):
    """Uniform right-closed probability bins, mean prediction vs observed rate."""
    out = ev.calibration_curve(models_long(spark, sf_dir), "score", "target", 10, ["model"])
    return out.withColumn("mean_pred", ev.np_round("mean_pred", 6))


HL_SQL = ML_SQL + f"""
, qr AS (SELECT model, quantile_cont(score, {probs_list(10)}) AS qs FROM ml GROUP BY model)
, qd AS (SELECT DISTINCT model, unnest(qs) AS edge FROM qr)
, qe AS (SELECT model, edge, row_number() OVER (PARTITION BY model ORDER BY edge) - 1 AS k FROM qd)
, qb AS (SELECT a.model, b.k AS decile, a.edge AS lo, b.edge AS hi FROM qe a JOIN qe b ON a.model = b.model AND b.k = a.k + 1)
, hl AS (SELECT ml.model, qb.decile, COUNT(target) AS n, SUM(target) AS obs_1, SUM(score) AS exp_1
         FROM ml JOIN qb ON ml.model = qb.model AND ml.score <= qb.hi AND (ml.score > qb.lo OR (qb.decile = 1 AND ml.score >= qb.lo))
         GROUP BY ml.model, qb.decile)
, hlt AS (SELECT model, decile, n, obs_1, exp_1, n - obs_1 AS obs_0, n - exp_1 AS exp_0 FROM hl)
"""


@query("hl_table", with_loan_book(HL_SQL + """
SELECT model, CAST(decile AS INTEGER) AS decile, CAST(n AS BIGINT) AS n, CAST(obs_1 AS BIGINT) AS obs_1,
       ROUNDX(exp_1, 6) AS exp_1, CAST(obs_0 AS BIGINT) AS obs_0, ROUNDX(exp_0, 6) AS exp_0 FROM hlt"""))
def hl_table_q(spark, sf_dir):
    """Observed and expected defaults per PD decile."""
    t = ev.hosmer_lemeshow_table(models_long(spark, sf_dir), "score", "target", 10, ["model"])
    return t.withColumn("exp_1", ev.np_round("exp_1", 6)).withColumn("exp_0", ev.np_round("exp_0", 6))


@query("hosmer_lemeshow", with_loan_book(HL_SQL + f"""
, s AS (SELECT model, SUM((obs_1 - exp_1) * (obs_1 - exp_1) / greatest(exp_1, 0.001)
                     + (obs_0 - exp_0) * (obs_0 - exp_0) / greatest(exp_0, 0.001)) AS hl, COUNT(*) AS n_groups
        FROM hlt GROUP BY model)
, s2 AS (SELECT *, {sql_chi2_sf('hl', '8')} AS p FROM s)
SELECT model, ROUNDX(hl, 4) AS hl_statistic, ROUNDX(p, 4) AS p_value, CAST(8 AS BIGINT) AS dof,
       CAST(n_groups AS BIGINT) AS n_groups, CASE WHEN p > 0.05 THEN 'Well calibrated' ELSE 'Poorly calibrated' END AS result
FROM s2"""))
def hosmer_lemeshow_q(spark, sf_dir):
    """Hosmer-Lemeshow statistic, p-value (dof = bins - 2) and verdict."""
    return ev.hosmer_lemeshow(models_long(spark, sf_dir), "score", "target", 10, ["model"])


@query("ks_curve", with_loan_book("""
, r AS (SELECT loan_id, pd_fine AS score,
               COUNT(*) OVER (ORDER BY pd_fine DESC, loan_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k,
               SUM(target) OVER (ORDER BY pd_fine DESC, loan_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cb,
               SUM(1 - target) OVER (ORDER BY pd_fine DESC, loan_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cg,
               COUNT(*) OVER () AS n, SUM(target) OVER () AS n1, SUM(1 - target) OVER () AS n0
        FROM loan_book WHERE pd_fine IS NOT NULL)
SELECT loan_id, score, CAST(k AS DOUBLE) / n * 100 AS pct_population, CAST(cb AS DOUBLE) / n1 * 100 AS cdf_bad,
       CAST(cg AS DOUBLE) / n0 * 100 AS cdf_good, abs(CAST(cb AS DOUBLE) / n1 * 100 - CAST(cg AS DOUBLE) / n0 * 100) AS gap
FROM r"""))
def ks_curve_q(spark, sf_dir):
    """Cumulative default and good shares by population share (score descending)."""
    return ev.ks_curve(loan_book(spark, sf_dir), "pd_fine", "target", "loan_id")


_grid = arange_grid(0.05, 0.80, 0.01)
_grid_case = "CASE " + " ".join(f"WHEN pd_fine < {t!r} THEN {j}" for j, t in enumerate(_grid)) + f" ELSE {len(_grid)} END"
_grid_rows = ", ".join(f"({j}, {t!r})" for j, t in enumerate(_grid)) + f", ({len(_grid)}, NULL)"
TC_SQL = f"""
, bk AS (SELECT {_grid_case} AS b, SUM(CASE WHEN target = 1 THEN 1 ELSE 0 END) AS pos,
                SUM(CASE WHEN target = 0 THEN 1 ELSE 0 END) AS neg FROM loan_book WHERE pd_fine IS NOT NULL GROUP BY 1)
, g AS (SELECT j, CAST(t AS DOUBLE) AS t FROM (VALUES {_grid_rows}) v(j, t))
, cu AS (SELECT g.j, g.t, SUM(COALESCE(pos, 0)) OVER (ORDER BY g.j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fn,
                SUM(COALESCE(neg, 0)) OVER (ORDER BY g.j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_le,
                SUM(COALESCE(neg, 0)) OVER () AS n_neg FROM g LEFT JOIN bk ON g.j = bk.b)
, tc AS (SELECT j, ROUNDX(CAST(t AS DOUBLE), 2) AS threshold, CAST(fn AS BIGINT) AS FN, CAST(n_neg - neg_le AS BIGINT) AS FP,
                CAST(fn * 5.0 + (n_neg - neg_le) * 1.0 AS DOUBLE) AS total_cost FROM cu WHERE j < {len(_grid)})
"""


@query("threshold_curve", with_loan_book(TC_SQL + "SELECT threshold, FN, FP, total_cost FROM tc"))
def threshold_curve_q(spark, sf_dir):
    """FN, FP and total cost at every grid threshold."""
    return threshold_curve(loan_book(spark, sf_dir), "pd_fine", "target", 5.0, 1.0).drop("j")


@query("cost_threshold", with_loan_book(TC_SQL + """
SELECT threshold AS optimal_threshold, total_cost AS min_cost FROM tc ORDER BY total_cost, j LIMIT 1"""))
def cost_threshold_q(spark, sf_dir):
    """the first grid threshold with minimal 5 x FN + 1 x FP."""
    return optimal_threshold(threshold_curve(loan_book(spark, sf_dir), "pd_fine", "target", 5.0, 1.0))


@query("best_per_metric", with_loan_book(METRICS_SQL + """
SELECT 'roc_auc' AS metric, arg_max(model, (roc_auc, model)) AS best_model, CAST(MAX(roc_auc) AS DOUBLE) AS value FROM mt
UNION ALL SELECT 'ks_statistic', arg_max(model, (ks_statistic, model)), MAX(ks_statistic) FROM mt
UNION ALL SELECT 'gini', arg_max(model, (gini, model)), MAX(gini) FROM mt
UNION ALL SELECT 'pr_auc', arg_max(model, (pr_auc, model)), MAX(pr_auc) FROM mt
UNION ALL SELECT 'f1_score', arg_max(model, (f1_score, model)), MAX(f1_score) FROM mt
UNION ALL SELECT 'brier_score', arg_min(model, (brier_score, model)), MIN(brier_score) FROM mt"""))
def best_per_metric_q(spark, sf_dir):
    """Best model per metric (lowest Brier, highest otherwise)."""
    return ev.best_per_metric(ev.all_metrics(models_long(spark, sf_dir), "score", "target", 0.5, ["model"]))
