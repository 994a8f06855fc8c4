"""F2-F6, F14 on raw columns with an oracle: the same logistic model fitted by
unrolled Newton steps with a 3 x 3 solve in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import np_round
from ..functions.pvalues import sql_normal_sf
from ..operators import models as md
from ..sources.loan_book import loan_book
from .registry import query
from .sql_parts import with_loan_book

STEPS = 12
_DET = "(h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02))"
# cofactors of the symmetric 3 x 3 matrix
_C = {"00": "(h11 * h22 - h12 * h12)", "01": "(h02 * h12 - h01 * h22)", "02": "(h01 * h12 - h02 * h11)",
      "11": "(h00 * h22 - h02 * h02)", "12": "(h01 * h02 - h00 * h12)", "22": "(h00 * h11 - h01 * h01)"}


def _newton_sql(tail: str) -> str:
    def sums(source):
        return f"""SELECT k, b0, b1, b2, SUM(y - p) AS g0, SUM((y - p) * x1) AS g1, SUM((y - p) * x2) AS g2, SUM(p * (1 - p)) AS h00,
  SUM(p * (1 - p) * x1) AS h01, SUM(p * (1 - p) * x2) AS h02, SUM(p * (1 - p) * x1 * x1) AS h11, SUM(p * (1 - p) * x1 * x2) AS h12,
  SUM(p * (1 - p) * x2 * x2) AS h22, SUM(y * ln(p) + (1 - y) * ln(1 - p)) AS llf, SUM(y) AS sy, COUNT(*) AS n
  FROM (SELECT s.*, x.*, 1.0 / (1.0 + exp(-(b0 + b1 * x1 + b2 * x2))) AS p FROM {source} s, x) GROUP BY k, b0, b1, b2"""

    step = lambda i: " + ".join(f"{_C[''.join(sorted(f'{i}{j}'))]} * g{j}" for j in range(3))
    body = with_loan_book(f"""
, x AS (SELECT CAST(target AS DOUBLE) AS y, credit_amount / 100000.0 AS x1, acct_balance / 1000.0 AS x2 FROM loan_book
        WHERE credit_amount IS NOT NULL AND acct_balance IS NOT NULL AND target IS NOT NULL)
, it(k, b0, b1, b2) AS (SELECT 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)
  UNION ALL SELECT k + 1, b0 + ({step(0)}) / {_DET}, b1 + ({step(1)}) / {_DET}, b2 + ({step(2)}) / {_DET}
  FROM ({sums(f"(SELECT * FROM it WHERE k < {STEPS})")}))
, f AS ({sums(f"(SELECT * FROM it WHERE k = {STEPS})")})
{tail}""")
    return body.replace("WITH ", "WITH RECURSIVE ", 1)


def _rows(spark, sf_dir):
    return loan_book(spark, sf_dir, materialize=True).select(
        "loan_id", "target", (F.col("credit_amount") / 100000.0).alias("x1"), (F.col("acct_balance") / 1000.0).alias("x2"))


@query("logit_raw_coefficients", _newton_sql(f"""
, c AS (SELECT 'const' AS term, b0 AS b, sqrt({_C['00']} / {_DET}) AS se FROM f UNION ALL
  SELECT 'x1', b1, sqrt({_C['11']} / {_DET}) FROM f UNION ALL SELECT 'x2', b2, sqrt({_C['22']} / {_DET}) FROM f)
SELECT term, ROUNDX(b, 4) AS beta, ROUNDX(se, 4) AS se, ROUNDX(b / se, 3) AS z, ROUNDX(2.0 * {sql_normal_sf('abs(b / se)')}, 4) AS p_value,
  ROUNDX(exp(b), 4) AS odds_ratio, CASE WHEN exp(b) > 1 THEN 'Increases risk' ELSE 'Decreases risk' END AS direction FROM c"""))
def logit_raw_coefficients_q(spark, sf_dir):
    """the logit of two raw columns on all loans and its coefficients."""
    fit = md.fit_logit(_rows(spark, sf_dir), ["x1", "x2"], "target")
    df = spark.createDataFrame(fit.coefficient_rows(), "term string, beta double, se double, z double, p_value double")
    return df.select("term", np_round("beta", 4).alias("beta"), np_round("se", 4).alias("se"), np_round("z", 3).alias("z"),
                     np_round("p_value", 4).alias("p_value"), np_round(F.exp("beta"), 4).alias("odds_ratio"),
                     md.or_direction(F.exp("beta")).alias("direction"))


@query("logit_raw_statistics", _newton_sql("""
, s AS (SELECT llf, sy * ln(sy / n) + (n - sy) * ln(1 - sy / n) AS lln, n FROM f)
SELECT CAST(n AS BIGINT) AS n, ROUNDX(llf, 2) AS llf, ROUNDX(lln, 2) AS llnull, ROUNDX(1 - llf / lln, 6) AS mcfadden_r2,
  ROUNDX(-2 * llf + 6, 2) AS aic, ROUNDX(-2 * llf + 3 * ln(n), 2) AS bic, ROUNDX(2 * (llf - lln), 2) AS llr,
  CASE WHEN 1 - llf / lln < 0.1 THEN 'Weak' WHEN 1 - llf / lln < 0.2 THEN 'Acceptable' WHEN 1 - llf / lln < 0.4 THEN 'Good' ELSE 'Excellent' END AS grade
FROM s"""))
def logit_raw_statistics_q(spark, sf_dir):
    """F4 of the same model."""
    s = md.fit_statistics(spark, md.fit_logit(_rows(spark, sf_dir), ["x1", "x2"], "target"))
    return s.select("n", *[np_round(c, 2).alias(c) for c in ("llf", "llnull")], np_round("mcfadden_r2", 6).alias("mcfadden_r2"),
                    *[np_round(c, 2).alias(c) for c in ("aic", "bic", "llr")], "grade")


@query("logit_raw_pd", _newton_sql("""
SELECT loan_id, ROUNDX(1.0 / (1.0 + exp(-(b0 + b1 * credit_amount / 100000.0 + b2 * acct_balance / 1000.0))), 5) AS pd
FROM loan_book, f"""))
def logit_raw_pd_q(spark, sf_dir):
    """probability of default of every loan by the same model."""
    rows = _rows(spark, sf_dir)
    fit = md.fit_logit(rows, ["x1", "x2"], "target")
    return md.predict_pd(rows, fit, "p").select("loan_id", np_round("p", 5).alias("pd"))


@query("logit_raw_attribution", _newton_sql("""
, m AS (SELECT AVG(x1) AS m1, AVG(x2) AS m2 FROM x)
SELECT 'x1' AS feature, ROUNDX(AVG(abs(b1 * (x1 - m1))), 4) AS mean_abs FROM x, m, f UNION ALL
SELECT 'x2', ROUNDX(AVG(abs(b2 * (x2 - m2))), 4) FROM x, m, f"""))
def logit_raw_attribution_q(spark, sf_dir):
    """mean absolute contribution of each column to the log-odds."""
    rows = _rows(spark, sf_dir)
    fit = md.fit_logit(rows, ["x1", "x2"], "target")
    out = md.global_importance(md.linear_attribution(rows, fit, "loan_id"))
    return out.select("feature", np_round("mean_abs", 4).alias("mean_abs"))


@query("vif_raw", with_loan_book(f"""
, x AS (SELECT credit_amount AS a, acct_balance AS b, CAST(n_lines AS DOUBLE) AS c FROM loan_book
        WHERE credit_amount IS NOT NULL AND acct_balance IS NOT NULL AND n_lines IS NOT NULL)
, h AS (SELECT SUM(a * a) AS h00, SUM(a * b) AS h01, SUM(a * c) AS h02, SUM(b * b) AS h11, SUM(b * c) AS h12, SUM(c * c) AS h22 FROM x)
, v AS (SELECT 'credit_amount' AS feature, h00 * {_C['00']} / {_DET} AS v FROM h UNION ALL
  SELECT 'acct_balance', h11 * {_C['11']} / {_DET} FROM h UNION ALL SELECT 'n_lines', h22 * {_C['22']} / {_DET} FROM h)
SELECT feature, ROUNDX(v, 4) AS vif, CASE WHEN v < 5 THEN 'OK' WHEN v < 10 THEN 'Moderate' ELSE 'High' END AS status FROM v"""))
def vif_raw_q(spark, sf_dir):
    """uncentered VIF of three raw columns."""
    return md.vif(loan_book(spark, sf_dir), ["credit_amount", "acct_balance", "n_lines"])
