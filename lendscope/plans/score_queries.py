"""H: scorecard and scoring on the loan book.

The oracle-checked scorecard model is the WoE-sum scorecard: every
IV-selected feature gets beta = 1 and the intercept is the log prior odds
ln(defaults / goods) of the fitting rows.  The logistic fit itself is in
``model_queries`` (rows-only check)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.labels import sql_band_rank, sql_ks_grade, sql_score_band, sql_score_decision
from ..operators import evaluation as ev
from ..operators import scorecard as sc
from ..operators import woe
from ..sources.loan_book import CATEGORICAL_FEATURES, NUMERIC_FEATURES, loan_book
from .registry import query
from .sql_parts import with_loan_book, woe_ctes
from .woe_queries import SPLIT_SQL, holdout

NUM, CAT = NUMERIC_FEATURES, CATEGORICAL_FEATURES
IV_MIN = 0.02
FACTOR, OFFSET = sc.scaling()


def woe_sum_model(fit_rows, target="target"):
    """Fit WoE on ``fit_rows``; unit betas for IV-selected features."""
    m = woe.fit_woe(fit_rows, target, NUM, CAT)
    chosen = set(woe.selected_features(woe.iv_summary(m), IV_MIN))
    feats = [f for f in NUM + CAT if f in chosen]   # model order: numeric, then categorical
    events, with_target = m.class_totals()
    intercept = math.log(events / (with_target - events))
    return sc.build_model(intercept, {f: 1.0 for f in feats}, m)


def _model_sql(src: str) -> str:
    """CTEs: WoE table of ``src`` (woe_r), selected features (sel), intercept
    (icp), per-feature intercept share (kshare)."""
    return woe_ctes(src=src) + f"""
, ivs AS (SELECT feature, ROUNDX(SUM(iv_raw), 4) AS iv FROM woe_r GROUP BY feature)
, sel AS (SELECT feature FROM ivs WHERE iv >= {IV_MIN})
, icp AS (SELECT ln(CAST(SUM(target) AS DOUBLE) / SUM(1 - target)) AS b0, (SELECT COUNT(*) FROM sel) AS k FROM {src})
"""


def _enc_long(book: str, clamp: bool) -> str:
    """Long encoding (loan_id, feature, value_num, value_cat, woe) of ``book``
    for the selected features."""
    num_in = ", ".join(f"'{c}'" for c in NUM)
    parts = []
    for f in NUM:
        x = f"CAST(lb.{f} AS DOUBLE)"
        if clamp:
            bin_pick = (f"(SELECT MIN(b.bin_id) FROM q_bins b WHERE b.feature = '{f}' AND {x} <= b.hi)")
            bin_expr = f"COALESCE({bin_pick}, (SELECT MAX(bin_id) FROM q_bins WHERE feature = '{f}'))"
        else:
            bin_expr = (f"(SELECT b.bin_id FROM q_bins b WHERE b.feature = '{f}' AND {x} <= b.hi "
                        f"AND ({x} > b.lo OR (b.bin_id = 1 AND {x} >= b.lo)))")
        parts.append(f"SELECT lb.loan_id, '{f}' AS feature, {x} AS value_num, CAST(NULL AS VARCHAR) AS value_cat, "
                     f"{bin_expr} AS bin_id, CAST(NULL AS VARCHAR) AS cat FROM {book} lb")
    for c in CAT:
        parts.append(f"SELECT lb.loan_id, '{c}' AS feature, CAST(NULL AS DOUBLE) AS value_num, CAST(lb.{c} AS VARCHAR) AS value_cat, "
                     f"CAST(NULL AS INTEGER) AS bin_id, CAST(lb.{c} AS VARCHAR) AS cat FROM {book} lb")
    union = " UNION ALL ".join(parts)
    miss = "0.0" if clamp else "NULL"
    return f"""
, el0 AS ({union})
, el AS (SELECT el0.loan_id, el0.feature, el0.value_num, el0.value_cat,
                COALESCE(w.woe, {miss}) AS woe
         FROM el0 JOIN sel ON sel.feature = el0.feature
         LEFT JOIN woe_r w ON w.feature = el0.feature
              AND ((el0.feature IN ({num_in}) AND w.bin_id = el0.bin_id) OR (el0.feature NOT IN ({num_in}) AND w.category = el0.cat)))
"""


def _score_sql(book: str, clamp: bool) -> str:
    return _enc_long(book, clamp) + f"""
, lo AS (SELECT el.loan_id, (SELECT b0 FROM icp) + SUM(woe) AS log_odds, COUNT(woe) AS n_woe FROM el GROUP BY el.loan_id)
, scored AS (SELECT lb.loan_id, lb.target, CAST(round_even({OFFSET!r} - {FACTOR!r} * lo.log_odds, 0) AS INTEGER) AS credit_score,
                    ROUNDX(1.0 / (1.0 + exp(-lo.log_odds)), 4) AS default_prob
             FROM {book} lb JOIN lo ON lb.loan_id = lo.loan_id WHERE lo.n_woe = (SELECT k FROM icp))
, scored2 AS (SELECT *, {sql_score_band('credit_score')} AS score_band, {sql_score_decision('credit_score')} AS decision FROM scored)
"""


BOOK_MODEL_SQL = _model_sql("loan_book")
TRAIN_MODEL_SQL = SPLIT_SQL + _model_sql("train_book")


@query("scorecard", with_loan_book(BOOK_MODEL_SQL + f"""
SELECT w.feature, w.bin_id, w.lo, w.hi, w.category, w.total AS count, w.default_rate, w.woe, CAST(1.0 AS DOUBLE) AS beta,
       ROUNDX(-(1.0 * w.woe + (SELECT b0 / k FROM icp)) * {FACTOR!r}, 1) AS points
FROM woe_r w JOIN sel ON sel.feature = w.feature"""))
def scorecard_q(spark, sf_dir):
    """H1/H2: points per (feature, bin) of the WoE-sum scorecard."""
    return sc.build_scorecard(woe_sum_model(loan_book(spark, sf_dir, materialize=True)))


@query("score_book", with_loan_book(BOOK_MODEL_SQL + _score_sql("loan_book", False) + """
SELECT loan_id, target, credit_score, default_prob, score_band, decision FROM scored2"""))
def score_book_q(spark, sf_dir):
    """H3/H6: score, PD, band and decision for every loan."""
    book = loan_book(spark, sf_dir, materialize=True)
    return sc.score(book, woe_sum_model(book), keep=["loan_id", "target"]).select(
        "loan_id", "target", "credit_score", "default_prob", "score_band", "decision")


BAND_SQL = f"""
SELECT score_band, CAST(COUNT(target) AS BIGINT) AS count, CAST(SUM(target) AS BIGINT) AS defaults,
       ROUNDX(AVG(CAST(target AS DOUBLE)), 3) AS default_rate, ROUNDX(AVG(credit_score), 3) AS avg_score,
       ROUNDX(1.0 - ROUNDX(AVG(CAST(target AS DOUBLE)), 3), 3) AS approval_rate, {sql_band_rank('score_band')} AS band_order
FROM scored2 GROUP BY score_band"""


@query("band_performance", with_loan_book(BOOK_MODEL_SQL + _score_sql("loan_book", False) + BAND_SQL))
def band_performance_q(spark, sf_dir):
    """H7: count, defaults, default rate, mean score and approval rate per score band."""
    book = loan_book(spark, sf_dir, materialize=True)
    return sc.band_performance(sc.score(book, woe_sum_model(book), keep=["loan_id", "target"]))


@query("points_range", with_loan_book(BOOK_MODEL_SQL + f"""
, card AS (SELECT w.feature, ROUNDX(-(1.0 * w.woe + (SELECT b0 / k FROM icp)) * {FACTOR!r}, 1) AS points
           FROM woe_r w JOIN sel ON sel.feature = w.feature)
SELECT feature, ROUNDX(MAX(points) - MIN(points), 1) AS points_range FROM card GROUP BY feature"""))
def points_range_q(spark, sf_dir):
    """H8: points range per scorecard feature, widest first."""
    return sc.points_range(sc.build_scorecard(woe_sum_model(loan_book(spark, sf_dir, materialize=True))))


@query("score_summary", with_loan_book(BOOK_MODEL_SQL + _score_sql("loan_book", False) + """
SELECT CAST(target AS VARCHAR) AS "group", CAST(COUNT(credit_score) AS BIGINT) AS n, MIN(credit_score) AS min_score,
       MAX(credit_score) AS max_score, ROUNDX(AVG(credit_score), 2) AS mean_score FROM scored2 GROUP BY target
UNION ALL
SELECT 'all', CAST(COUNT(credit_score) AS BIGINT), MIN(credit_score), MAX(credit_score), ROUNDX(AVG(credit_score), 2) FROM scored2"""))
def score_summary_q(spark, sf_dir):
    """Score count, range and mean per class and overall."""
    book = loan_book(spark, sf_dir, materialize=True)
    return sc.score_summary(sc.score(book, woe_sum_model(book), keep=["loan_id", "target"]))


def _split_model(spark, sf_dir):
    train, new = holdout(loan_book(spark, sf_dir, materialize=True))
    return train, woe_sum_model(train), new


@query("score_breakdown", with_loan_book(TRAIN_MODEL_SQL + _enc_long("new_book", True) + f"""
SELECT el.loan_id, el.feature, el.value_num, el.value_cat, ROUNDX(el.woe, 4) AS woe,
       ROUNDX(-(1.0 * el.woe + (SELECT b0 / k FROM icp)) * {FACTOR!r}, 1) AS points FROM el"""))
def score_breakdown_q(spark, sf_dir):
    """H4: per applicant (hold-out rows, model fitted on the rest) and
    feature: raw value, WoE (clamped / unseen -> 0) and points."""
    _, model, new = _split_model(spark, sf_dir)
    b = sc.breakdown(new, model, "loan_id", new_data=True)
    num = F.col("feature").isin(NUM)
    return b.select("loan_id", "feature", F.when(num, F.col("value").cast("double")).alias("value_num"),
                    F.when(~num, F.col("value")).alias("value_cat"), "woe", "points")


@query("reason_codes", with_loan_book(TRAIN_MODEL_SQL + _enc_long("new_book", True) + f"""
, pts AS (SELECT el.loan_id, el.feature, ROUNDX(-(1.0 * el.woe + (SELECT b0 / k FROM icp)) * {FACTOR!r}, 1) AS points
         FROM el)
, ord AS (SELECT loan_id, feature, points, row_number() OVER (PARTITION BY loan_id ORDER BY points,
                 CASE feature {" ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(NUM + CAT))} END) AS rank FROM pts)
SELECT loan_id, CAST(rank AS INTEGER) AS rank, feature, points FROM ord WHERE rank <= 3"""))
def reason_codes_q(spark, sf_dir):
    """H5: the three lowest-point features per hold-out applicant."""
    _, model, new = _split_model(spark, sf_dir)
    return sc.reason_codes(new, model, "loan_id", 3, new_data=True)


@query("scorecard_validation", with_loan_book(TRAIN_MODEL_SQL + _score_sql("new_book", True).replace(
    "WHERE lo.n_woe = (SELECT k FROM icp)", "") + f"""
, sc AS (SELECT -credit_score AS score, SUM(CASE WHEN target = 1 THEN 1 ELSE 0 END) AS pos,
                SUM(CASE WHEN target = 0 THEN 1 ELSE 0 END) AS neg FROM scored2 GROUP BY 1)
, roc AS (SELECT pos, neg, SUM(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
                 SUM(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
                 SUM(pos) OVER () AS P, SUM(neg) OVER () AS N FROM sc)
, rk AS (SELECT SUM(neg * (tp * 2 - pos)) / (CAST(MIN(P) AS DOUBLE) * MIN(N) * 2) AS auc,
                greatest(MAX(CAST(tp AS DOUBLE) / P - CAST(fp AS DOUBLE) / N), 0.0) AS ks FROM roc)
SELECT ROUNDX(auc, 4) AS roc_auc, ROUNDX(ks, 4) AS ks_statistic, ROUNDX(auc * 2 - 1, 4) AS gini,
       {sql_ks_grade('ks')} AS ks_grade FROM rk"""))
def scorecard_validation_q(spark, sf_dir):
    """AUC/KS/Gini of -score on the hold-out rows."""
    _, model, new = _split_model(spark, sf_dir)
    scored = sc.score(new, model, keep=["loan_id", "target"], new_data=True)
    return ev.auc_ks_gini(scored.withColumn("neg_score", -F.col("credit_score")), "neg_score", "target")


def _score_hist_sql(bins: int = 30) -> str:
    x = "CAST(credit_score AS DOUBLE)"
    case = " ".join(f"WHEN x < e{i} THEN {i - 1}" for i in range(1, bins))
    edge_cols = ", ".join(f"{i} * ((mx - mn) / {bins}) + mn AS e{i}" for i in range(bins)) + f", mx AS e{bins}"
    arr = "[" + ", ".join(f"e{i}" for i in range(bins + 1)) + "]"
    return f"""
, mm AS (SELECT MIN({x}) AS mn, MAX({x}) AS mx FROM scored2)
, ed AS (SELECT {edge_cols} FROM mm)
, hb AS (SELECT target, CASE {case} ELSE {bins - 1} END AS bin FROM (SELECT target, {x} AS x FROM scored2) s, ed)
, hc AS (SELECT target, bin, COUNT(*) AS n FROM hb GROUP BY target, bin)
, cn AS (SELECT target, COUNT(*) AS n_class FROM scored2 GROUP BY target)
SELECT hc.target, CAST(hc.bin AS INTEGER) AS bin, {arr}[hc.bin + 1] AS lo, {arr}[hc.bin + 2] AS hi, CAST(hc.n AS BIGINT) AS n,
       hc.n / (cn.n_class * ({arr}[hc.bin + 2] - {arr}[hc.bin + 1])) AS density
FROM hc JOIN cn ON hc.target = cn.target, ed"""


@query("score_histogram", with_loan_book(BOOK_MODEL_SQL + _score_sql("loan_book", False) + _score_hist_sql(30)))
def score_histogram_q(spark, sf_dir):
    """H9: score distribution by class (equal-width histogram, density)."""
    from ..operators.stats_basic import histogram_by_class

    book = loan_book(spark, sf_dir, materialize=True)
    scored = sc.score(book, woe_sum_model(book), keep=["loan_id", "target"])
    return histogram_by_class(scored, "credit_score", "target", 30)
