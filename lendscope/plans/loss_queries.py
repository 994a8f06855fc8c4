"""The book's loss distribution without draws, its risk
metrics and tail, for the base case and all scenario families."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import np_round
from ..operators import loss_dist, risk
from ..sources.loan_book import loan_book
from .registry import query
from .sql_parts import with_loan_book

BASE = [risk.base_scenario()]
POINTS = 240
METRICS = ["var_95", "var_99", "cvar_95", "cvar_99", "ec_95", "ec_99"]


def model_of(spark, sf_dir, scenarios) -> loss_dist.LossModel:
    return loss_dist.LossModel(loan_book(spark, sf_dir), "pd", "credit_amount", scenarios)


_DIST = "SELECT scenario, CAST(i AS INTEGER) AS i, ROUNDX(loss, 0) AS loss, ROUNDX(cdf, 6) AS cdf FROM ld_grid"


def _rows(df):
    return df.select("scenario", "i", np_round("loss", 0).alias("loss"), np_round("cdf", 6).alias("cdf"))


@query("loss_distribution", with_loan_book(loss_dist.oracle_ctes(BASE, points=POINTS) + _DIST))
def loss_distribution_q(spark, sf_dir):
    """The CDF of the portfolio loss on an even grid of losses."""
    return _rows(model_of(spark, sf_dir, BASE).distribution(POINTS))


@query("loss_tail", with_loan_book(loss_dist.oracle_ctes(BASE, points=POINTS) + _DIST + " WHERE cdf >= 0.99"))
def loss_tail_q(spark, sf_dir):
    """The losses at or beyond the 99 % quantile."""
    return _rows(model_of(spark, sf_dir, BASE).tail(0.99, POINTS))


_ALL = BASE + risk.lgd_sensitivity_scenarios() + risk.stress_scenarios() + risk.policy_scenarios()


@query("loss_metrics", with_loan_book(loss_dist.oracle_ctes(_ALL) + f"""
SELECT scenario, ROUNDX(el, 0) AS el, ROUNDX(sd, 0) AS std, {", ".join(f"ROUNDX({c}, 0) AS {c}" for c in METRICS)} FROM ld_metrics"""))
def loss_metrics_q(spark, sf_dir):
    """EL, standard deviation, VaR, CVaR and economic capital of
    the base case and every scenario from one scan of the book."""
    m = model_of(spark, sf_dir, _ALL).metrics()
    return m.select("scenario", *[np_round(c, 0).alias(c) for c in ["el", "std", *METRICS]])


_CAPITAL = ["total_exposure", "expected_loss", "el_pct", "var_95", "var_99", "cvar_99", "economic_capital_99"]


@query("risk_capital_summary", with_loan_book(loss_dist.oracle_ctes(BASE) + f"""
, t AS (SELECT ROUNDX(ead, 0) AS total_exposure, ROUNDX(el, 0) AS expected_loss, ROUNDX(el / ead, 6) AS el_pct, ROUNDX(var_95, 0) AS var_95,
    ROUNDX(var_99, 0) AS var_99, ROUNDX(cvar_99, 0) AS cvar_99, ROUNDX(ec_99, 0) AS economic_capital_99 FROM ld_metrics, (SELECT SUM(credit_amount) AS ead FROM loan_book) b)
SELECT metric, value FROM (UNPIVOT t ON {", ".join(_CAPITAL)} INTO NAME metric VALUE value)"""))
def risk_capital_summary_q(spark, sf_dir):
    """The named values of the base case, VaR and capital included."""
    m = model_of(spark, sf_dir, BASE).metrics().withColumn("one", F.lit(1))
    total = loan_book(spark, sf_dir).agg(F.sum("credit_amount").alias("ead"), F.lit(1).alias("one"))
    j = m.join(total, "one")   # one row each
    t = j.select(np_round("ead", 0).alias("total_exposure"), np_round("el", 0).alias("expected_loss"), np_round(F.col("el") / F.col("ead"), 6).alias("el_pct"),
                 *[np_round(c, 0).alias(c) for c in ("var_95", "var_99", "cvar_99")], np_round("ec_99", 0).alias("economic_capital_99"))
    return t.unpivot([], _CAPITAL, "metric", "value")
