"""Exact portfolio what-ifs and small record operators, each with its oracle:
scenario aggregates (I8-I10, I12), class weights (F12), code decoding (B4),
applicant defaults (A4), term labels (B11), model grade (B10), key/value sink
(A3), the second cost grid (F13) and the scorecard of a fitted model (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import mcfadden_grade
from ..functions.numeric import np_round
from ..operators import loss_dist, prep, risk, woe
from ..operators import models as md
from ..operators import scorecard as sc
from ..operators.threshold import threshold_curve
from ..sources import german_credit as gc
from ..sources.io import write_key_values
from ..sources.loan_book import CATEGORICAL_FEATURES as CAT
from ..sources.loan_book import NUMERIC_FEATURES as NUM
from ..sources.loan_book import loan_book
from .io_queries import scratch_dir
from .registry import query
from .sql_parts import with_loan_book
from .woe_queries import holdout


def _beta_moments(scen: risk.Scenario) -> tuple[float, float]:
    """(mean, second moment) of the scenario's LGD distribution."""
    a, b = scen.lgd_a, scen.lgd_b
    m = a / (a + b)
    return m, a * b / ((a + b) ** 2 * (a + b + 1)) + m * m


def _whatif_rows(scenarios):
    return [(s.name, float(s.pd_mult), 2.0 if s.pd_max is None else float(s.pd_max), *_beta_moments(s)) for s in scenarios]


def _whatif_sql(scenarios, tail: str) -> str:
    values = ", ".join(f"('{n}', CAST({m!r} AS DOUBLE), CAST({t!r} AS DOUBLE), CAST({l1!r} AS DOUBLE), CAST({l2!r} AS DOUBLE))"
                       for n, m, t, l1, l2 in _whatif_rows(scenarios))
    return with_loan_book(f"""
, s AS (SELECT * FROM (VALUES {values}) v(scenario, mult, pd_max, l1, l2))
, c AS (SELECT s.*, least(pd * mult, 1.0) AS p, credit_amount AS ead FROM loan_book, s WHERE pd <= pd_max)
, w AS (SELECT scenario, mult, pd_max, l1, CAST(COUNT(*) AS BIGINT) AS n_loans, SUM(ead) AS ead, AVG(p) AS mean_pd, SUM(p * l1 * ead) AS el,
          sqrt(SUM(ead * ead * (p * l2 - p * l1 * p * l1))) AS sd FROM c GROUP BY ALL)
, b AS (SELECT CAST(COUNT(*) AS BIGINT) AS n_all, SUM(credit_amount) AS ead_all, SUM(pd * 0.45 * credit_amount) AS el_all FROM loan_book)
{loss_dist.oracle_ctes(scenarios)}
{tail}""")


_CAPITAL = ["var_95", "var_99", "ec_95", "ec_99"]
_WHATIF = "ROUNDX(w.el, 2) AS el, ROUNDX(w.sd, 2) AS std, " + ", ".join(f"ROUNDX(ld.{c}, 0) AS {c}" for c in _CAPITAL)
_JOINED = "FROM w JOIN ld_metrics ld ON ld.scenario = w.scenario"


def _with_capital(w, spark, sf_dir, scenarios):
    """The moments with VaR and economic capital of the loss distribution."""
    m = loss_dist.LossModel(loan_book(spark, sf_dir), "pd", "credit_amount", scenarios).metrics()
    return w.join(m.select("scenario", *_CAPITAL), "scenario")   # one row a scenario


def _capital_columns():
    return [np_round(c, 0).alias(c) for c in _CAPITAL]


@query("lgd_sensitivity_exact", _whatif_sql(risk.lgd_sensitivity_scenarios(), f"""
SELECT w.scenario, ROUNDX(l1, 6) AS lgd, {_WHATIF}, ROUNDX(w.el / ead * 100, 6) AS el_pct {_JOINED}"""))
def lgd_sensitivity_exact_q(spark, sf_dir):
    """I8 without simulation: expected loss, its standard deviation, VaR and
    economic capital for each LGD level."""
    scen = risk.lgd_sensitivity_scenarios()
    w = risk.scenario_moments(loan_book(spark, sf_dir), "pd", "credit_amount", _whatif_rows(scen))
    w = _with_capital(w, spark, sf_dir, scen)
    return w.select("scenario", np_round("l1", 6).alias("lgd"), np_round("el", 2).alias("el"), np_round("std", 2).alias("std"), *_capital_columns(),
                    np_round(F.col("el") / F.col("ead") * 100, 6).alias("el_pct"))


@query("pd_stress_exact", _whatif_sql(risk.stress_scenarios(), f"""
SELECT w.scenario, mult AS pd_mult, ROUNDX(mean_pd, 6) AS mean_pd, {_WHATIF}, ROUNDX(w.el / ead * 100, 6) AS el_pct {_JOINED}"""))
def pd_stress_exact_q(spark, sf_dir):
    """I9 without simulation: mean stressed PD, expected loss, its standard
    deviation and its share of the exposure, VaR and economic capital."""
    scen = risk.stress_scenarios()
    w = risk.scenario_moments(loan_book(spark, sf_dir), "pd", "credit_amount", _whatif_rows(scen))
    w = _with_capital(w, spark, sf_dir, scen)
    return w.select("scenario", F.col("mult").alias("pd_mult"), np_round("mean_pd", 6).alias("mean_pd"), np_round("el", 2).alias("el"),
                    np_round("std", 2).alias("std"), *_capital_columns(), np_round(F.col("el") / F.col("ead") * 100, 6).alias("el_pct"))


@query("credit_policy_exact", _whatif_sql(risk.policy_scenarios(), f"""
SELECT pd_max AS pd_threshold, n_loans AS approved_loans, n_all - n_loans AS rejected_loans,
       ROUNDX(CAST(n_loans AS DOUBLE) / n_all * 100, 6) AS approval_rate_pct, ROUNDX(ead, 2) AS approved_ead, {_WHATIF},
       ROUNDX((1 - w.el / el_all) * 100, 6) AS el_reduction_pct {_JOINED}, b"""))
def credit_policy_exact_q(spark, sf_dir):
    """I10 without simulation: approvals, exposure, expected loss, VaR, capital
    and the reduction of loss for each PD threshold; the book's totals come from the same
    pass (a scenario that approves every loan)."""
    everything = risk.Scenario("all", 1.0, *risk.beta_params(risk.LGD_MEAN, risk.LGD_STD), pd_max=2.0)
    w = risk.scenario_moments(loan_book(spark, sf_dir), "pd", "credit_amount", _whatif_rows([everything, *risk.policy_scenarios()]))
    total = w.where("scenario = 'all'").select(F.lit(1).alias("k"), F.col("n_loans").alias("n_all"), F.col("el").alias("el_all"))
    j = w.where("scenario <> 'all'").withColumn("k", F.lit(1)).join(total, "k")   # one row of totals
    j = _with_capital(j, spark, sf_dir, risk.policy_scenarios())
    return j.select(F.col("pd_max").alias("pd_threshold"), F.col("n_loans").alias("approved_loans"),
                    (F.col("n_all") - F.col("n_loans")).alias("rejected_loans"),
                    np_round(F.col("n_loans").cast("double") / F.col("n_all") * 100, 6).alias("approval_rate_pct"),
                    np_round("ead", 2).alias("approved_ead"), np_round("el", 2).alias("el"), np_round("std", 2).alias("std"), *_capital_columns(),
                    np_round((1 - F.col("el") / F.col("el_all")) * 100, 6).alias("el_reduction_pct"))


_SUMMARY_SQL = _whatif_sql([risk.base_scenario()], """
, t AS (SELECT ROUNDX(ead, 2) AS total_exposure, ROUNDX(w.el, 2) AS expected_loss, ROUNDX(w.el / ead, 6) AS el_pct, ROUNDX(w.sd, 2) AS std FROM w)
SELECT metric, value FROM (UNPIVOT t ON total_exposure, expected_loss, el_pct, std INTO NAME metric VALUE value)""")


def _summary(spark, sf_dir):
    w = risk.scenario_moments(loan_book(spark, sf_dir), "pd", "credit_amount", _whatif_rows([risk.base_scenario()]))
    t = w.select(np_round("ead", 2).alias("total_exposure"), np_round("el", 2).alias("expected_loss"),
                 np_round(F.col("el") / F.col("ead"), 6).alias("el_pct"), np_round("std", 2).alias("std"))
    return t.unpivot([], t.columns, "metric", "value")


@query("risk_summary_exact", _SUMMARY_SQL)
def risk_summary_exact_q(spark, sf_dir):
    """I12's values that have exact formulas, as (metric, value)."""
    return _summary(spark, sf_dir)


@query("key_value_sink", _SUMMARY_SQL)
def key_value_sink_q(spark, sf_dir):
    """A3: the summary written as a headerless key,value file and read back."""
    path = scratch_dir(spark, "key-values")
    write_key_values(_summary(spark, sf_dir), path)
    return spark.read.schema("metric string, value double").csv(path)


_LISTED = {"numeric": [*NUM, "not_there"], "categorical": [*CAT, "neither"]}


@query("feature_groups", with_loan_book(" UNION ALL ".join(
    f"SELECT '{g}' AS kind, '{c}' AS feature, CAST(COUNT({c}) AS BIGINT) AS filled, CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS missing FROM loan_book"
    for g, cols in (("numeric", NUM), ("categorical", CAT)) for c in cols)))
def feature_groups_q(spark, sf_dir):
    """The listed features that the book has, by kind, with their filled
    and missing rows; listed names that it lacks are left out."""
    book = loan_book(spark, sf_dir)
    numeric, categorical = prep.feature_groups(book, _LISTED["numeric"], _LISTED["categorical"])
    kind = {f: "numeric" for f in numeric} | {f: "categorical" for f in categorical}
    r = book.select([F.col(f).cast("string").alias(f) for f in kind]).unpivot([], list(kind), "feature", "value")
    kinds = F.create_map(*[F.lit(x) for kv in kind.items() for x in kv])
    return (r.groupBy("feature").agg(F.count("value").alias("filled"), F.count(F.when(F.col("value").isNull(), 1)).alias("missing"))
            .select(kinds[F.col("feature")].alias("kind"), "feature", "filled", "missing"))


@query("class_weights", with_loan_book("""
, c AS (SELECT target, COUNT(*) AS n FROM loan_book GROUP BY target), t AS (SELECT SUM(n) AS n, COUNT(*) AS k FROM c)
SELECT target, CAST(c.n AS BIGINT) AS n, CAST(t.n AS DOUBLE) / (t.k * c.n) AS weight FROM c, t"""))
def class_weights_q(spark, sf_dir):
    """balanced weight n / (k n_c) of each class, as the models use it."""
    weighted = md.balanced_weights(loan_book(spark, sf_dir).select("loan_id", "target"), "target")
    return weighted.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight"))


def _codes_sql():
    out = []
    for i, (col, labels) in enumerate(gc.LABEL_MAPS.items()):
        low = min(labels)
        cases = " ".join(f"WHEN {k} THEN '{v}'" for k, v in labels.items())
        out.append(f"SELECT loan_id, '{col}' AS feature, CASE {low} + (loan_id + {i}) % {len(labels) + 1} {cases} END AS label FROM loan_book")
    return "\nUNION ALL\n".join(out)


@query("decode_categoricals", with_loan_book(
    f", d AS ({_codes_sql()}) SELECT feature, label, CAST(COUNT(*) AS BIGINT) AS n FROM d GROUP BY ALL"))
def decode_categoricals_q(spark, sf_dir):
    """The code maps of all 13 categoricals; an unknown code has no label.
    The stand-in input gives each loan a code per categorical (one more than
    the known ones) from its id."""
    book = loan_book(spark, sf_dir).select("loan_id")
    coded = book.select("loan_id", *[(F.lit(min(m)) + (F.col("loan_id") + i) % (len(m) + 1)).cast("int").alias(c)
                                     for i, (c, m) in enumerate(gc.LABEL_MAPS.items())])
    for c, m in gc.LABEL_MAPS.items():
        coded = prep.decode(coded, c, m, out=f"_{c}")
    labels = coded.select("loan_id", *[F.col(f"_{c}").alias(c) for c in gc.LABEL_MAPS])
    return labels.unpivot("loan_id", list(gc.LABEL_MAPS), "feature", "label").groupBy("feature", "label").agg(F.count(F.lit(1)).alias("n"))


@query("applicant_defaults", with_loan_book("""
SELECT loan_id, CASE WHEN loan_id % 3 = 0 THEN 1 ELSE CAST(loan_id % 3 AS INTEGER) END AS other_debtors,
       2 AS property, 2 AS foreign_worker FROM loan_book"""))
def applicant_defaults_q(spark, sf_dir):
    """A4: fields that the applicant form hides get their fixed defaults; in
    the stand-in input one of them is missing for a third of the loans and
    the others are not there at all."""
    asked = loan_book(spark, sf_dir).select("loan_id", F.when(F.col("loan_id") % 3 > 0, (F.col("loan_id") % 3).cast("int")).alias("other_debtors"))
    return prep.with_defaults(asked, gc.HIDDEN_DEFAULTS).select("loan_id", "other_debtors", "property", "foreign_worker")


@query("term_labels", with_loan_book("""
SELECT c AS term, array_to_string(list_transform(string_split(replace(replace(c, '_woe', ''), '_', ' '), ' '),
       lambda w: upper(w[1]) || lower(w[2:])), ' ') AS label, CAST(COUNT(*) AS BIGINT) AS n
FROM (SELECT unnest(['credit_amount_woe', 'acct_balance_woe', 'n_lines_woe', 'total_qty_woe', 'priority_woe', 'segment_woe', 'region_woe']) AS c FROM loan_book)
GROUP BY ALL"""))
def term_labels_q(spark, sf_dir):
    """Readable names of the model's terms, with the loans behind each."""
    terms = F.array(*[F.lit(f"{c}_woe") for c in NUM + CAT])
    return (loan_book(spark, sf_dir).select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
            .select("term", md.term_label(F.col("term")).alias("label"), "n"))


@query("mcfadden_grades", with_loan_book("""
, b AS (SELECT priority, AVG(CAST(target AS DOUBLE)) AS p, SUM(target) AS e, COUNT(*) AS n FROM loan_book GROUP BY priority)
, l AS (SELECT SUM(e * ln(p) + (n - e) * ln(1 - p)) AS llf, SUM(e) AS te, SUM(n) AS tn FROM b WHERE p > 0 AND p < 1)
, r AS (SELECT 1 - llf / (te * ln(te / tn) + (tn - te) * ln(1 - te / tn)) AS r2 FROM l)
SELECT ROUNDX(r2, 6) AS mcfadden_r2, CASE WHEN r2 < 0.1 THEN 'Weak' WHEN r2 < 0.2 THEN 'Acceptable' WHEN r2 < 0.4 THEN 'Good' ELSE 'Excellent' END AS grade FROM r"""))
def mcfadden_grades_q(spark, sf_dir):
    """Pseudo R2 of the model with one level mean per priority, graded."""
    b = loan_book(spark, sf_dir).groupBy("priority").agg(F.avg(F.col("target").cast("double")).alias("p"), F.sum("target").alias("e"),
                                                        F.count(F.lit(1)).alias("n")).where("p > 0 and p < 1")
    t = b.agg(F.sum(F.col("e") * F.ln("p") + (F.col("n") - F.col("e")) * F.ln(1 - F.col("p"))).alias("llf"),
              F.sum("e").alias("te"), F.sum("n").alias("tn"))
    q = F.col("te") / F.col("tn")
    r2 = 1 - F.col("llf") / (F.col("te") * F.ln(q) + (F.col("tn") - F.col("te")) * F.ln(1 - q))
    return t.select(r2.alias("r2")).select(np_round("r2", 6).alias("mcfadden_r2"), mcfadden_grade(F.col("r2")).alias("grade"))


_GRID = [0.10 + j * ((0.89 - 0.10) / 79) for j in range(80)]
_GRID_CASE = "CASE " + " ".join(f"WHEN pd_fine < {t!r} THEN {j}" for j, t in enumerate(_GRID)) + f" ELSE {len(_GRID)} END"
_GRID_ROWS = ", ".join(f"({j}, CAST({t!r} AS DOUBLE))" for j, t in enumerate(_GRID))


@query("cost_curve_80", with_loan_book(f"""
, bk AS (SELECT {_GRID_CASE} AS b, target FROM loan_book WHERE pd_fine IS NOT NULL)
, g AS (SELECT * FROM (VALUES {_GRID_ROWS}) v(j, t))
SELECT ROUNDX(t, 2) AS threshold, CAST(SUM(CASE WHEN target = 1 AND b <= j THEN 1 ELSE 0 END) AS BIGINT) AS FN,
       CAST(SUM(CASE WHEN target = 0 AND b > j THEN 1 ELSE 0 END) AS BIGINT) AS FP,
       CAST(SUM(CASE WHEN target = 1 AND b <= j THEN 5.0 WHEN target = 0 AND b > j THEN 1.0 ELSE 0 END) AS DOUBLE) AS total_cost
FROM g, (SELECT b, target FROM bk) x GROUP BY j, t"""))
def cost_curve_80_q(spark, sf_dir):
    """F13 on the finer grid: 80 thresholds from 0.10 to 0.89."""
    return threshold_curve(loan_book(spark, sf_dir), "pd_fine", "target", 5.0, 1.0, _GRID).drop("j")


@query("fitted_scorecard")
def fitted_scorecard_q(spark, sf_dir):
    """F2 to H2: WoE and logit fitted on the training rows, the scorecard of
    the fitted coefficients."""
    return sc.build_scorecard(_fitted(spark, sf_dir)[0])


@query("fitted_score_validation")
def fitted_score_validation_q(spark, sf_dir):
    """The hold-out rows scored by the fitted scorecard; full
    metrics of its default probability."""
    from ..operators import evaluation as ev

    model, test = _fitted(spark, sf_dir)
    scored = sc.score(test, model, keep=["loan_id", "target"], new_data=True)
    return ev.all_metrics(scored.withColumn("model", F.lit("scorecard")), "default_prob", "target", 0.5, ["model"])


def _fitted(spark, sf_dir):
    train, test = holdout(loan_book(spark, sf_dir, materialize=True))
    wm = woe.fit_woe(train, "target", NUM, CAT)
    feats = woe.selected_features(woe.iv_summary(wm), 0.02)
    enc = woe.encode(train, wm, feats, keep=["loan_id", "target"])
    fit = md.fit_logit(enc, [f + "_woe" for f in feats], "target")
    return sc.build_model(fit.intercept, dict(zip(feats, fit.coef)), wm), test
