"""Invariants, partition independence and plan-shape checks."""

import math

import pytest
from pyspark.sql import functions as F

from lendscope.operators import evaluation as ev
from lendscope.operators import hypothesis as H
from lendscope.operators import risk
from lendscope.operators import scorecard as sc
from lendscope.operators.ordered import exact_quantiles, prefix_sums
from lendscope.plans.score_queries import woe_sum_model
from lendscope.sources.loan_book import loan_book
from tests.conftest import SMOKE


@pytest.fixture(scope="module")
def book(spark):
    return loan_book(spark, SMOKE).persist()


def test_gini_and_auc_rank_identity(book):
    r = ev.ranking_metrics(ev.roc_table(book, "credit_amount", "target")).collect()[0]
    mw = H.mann_whitney(book, ["credit_amount"], "target").collect()[0]
    assert 1 - mw["u_stat"] / (mw["n0"] * mw["n1"]) == pytest.approx(r["auc"], abs=1e-6)
    g = ev.auc_ks_gini(book, "credit_amount", "target").collect()[0]
    assert g["gini"] == pytest.approx(round(2 * r["auc"] - 1, 4), abs=1e-9)


def test_prefix_sum_paths_agree(book):
    small = ev.roc_table(book, "pd_fine", "target").orderBy("threshold").collect()
    ranged = ev.roc_table(book, "pd_fine", "target", local_limit=0).orderBy("threshold").collect()
    assert small == ranged


def test_quantile_paths_agree(book):
    long = book.select(F.lit("x").alias("g"), "credit_amount")
    a = exact_quantiles(long, ["g"], "credit_amount", [0.1, 0.5, 0.9]).orderBy("q_idx").collect()
    b = exact_quantiles(long, ["g"], "credit_amount", [0.1, 0.5, 0.9], local_limit=0).orderBy("q_idx").collect()
    assert a == b


def test_confusion_counts_sum_to_n(book):
    r = ev.pointwise_metrics(book, "pd", "target").collect()[0]
    assert r["TP"] + r["TN"] + r["FP"] + r["FN"] == book.count()


def test_breakdown_points_add_up_to_score(spark, book):
    model = woe_sum_model(book)
    scored = {r["loan_id"]: r["credit_score"] for r in sc.score(book, model, keep=["loan_id"]).collect()}
    parts = sc.breakdown(book, model, "loan_id", new_data=False).groupBy("loan_id").agg(
        F.sum("points").alias("pts")).collect()
    k = len(model.features)
    for r in parts[:200]:
        assert abs(model.offset + r["pts"] - scored[r["loan_id"]]) <= 0.5 + 0.05 * k + 1e-9


def _sim(book, parts, n_sims=200):
    df = book.repartition(parts)
    losses = risk.simulate_losses(df, "loan_id", "pd", "credit_amount", [risk.base_scenario()], n_sims,
                                  block_rows=300)
    return {r["sim_id"]: r["loss"] for r in losses.collect()}


def test_monte_carlo_independent_of_partitioning(book):
    a, b = _sim(book, 1), _sim(book, 7)
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-12)


def test_monte_carlo_mean_and_variance(book):
    n_sims = 2000
    losses = risk.simulate_losses(book, "loan_id", "pd", "credit_amount", [risk.base_scenario()], n_sims,
                                  block_rows=300)
    m = losses.agg(F.avg("loss").alias("m"), F.stddev_pop("loss").alias("s")).collect()[0]
    a, b = risk.beta_params(0.45, 0.10)
    e_l, e_l2 = a / (a + b), a * (a + 1) / ((a + b) * (a + b + 1))
    stats = book.agg(F.sum(F.col("pd") * e_l * F.col("credit_amount")).alias("mu"),
                     F.sum(F.col("credit_amount") ** 2 * (F.col("pd") * e_l2 - (F.col("pd") * e_l) ** 2)).alias("var")
                     ).collect()[0]
    assert abs(m["m"] - stats["mu"]) < 4 * math.sqrt(stats["var"] / n_sims)
    assert m["s"] == pytest.approx(math.sqrt(stats["var"]), rel=0.1)


def test_md5_simulation_counts_defaults(book):
    losses = risk.simulate_losses_md5(book, "loan_id", "pd", "credit_amount", 5).collect()
    assert len(losses) == 5 and all(r["loss"] >= 0 for r in losses)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranged_paths_have_no_single_partition_exchange(book):
    pre = prefix_sums(book.select("loan_id", "target", F.lit(1).alias("one")), [], "loan_id", ["one"],
                      local_limit=0)
    import re

    plan = _plan(pre)
    row_side = plan.split("BroadcastExchange", 1)[0]
    # rows move once, hash-partitioned by bucket; any single-partition step
    # runs over the small per-bucket totals that get broadcast
    assert "SinglePartition" not in row_side
    assert re.search(r"hashpartitioning\(_b#", row_side)
    assert "checkpoint" not in plan.lower()


def test_loan_book_scans_are_pruned(spark):
    plan = loan_book(spark, SMOKE)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderdate" not in plan and "l_extendedprice" not in plan


def test_correlation_with_nulls_in_65_columns(spark):
    """Each pair uses the rows where both are there, at any number of columns."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 65))
    x[:, 1] += x[:, 0]
    x[rng.random(x.shape) < 0.03] = np.nan
    cols = [f"c{i}" for i in range(65)]
    df = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in r] for r in x], ", ".join(f"{c} double" for c in cols))
    from lendscope.operators import stats_basic as sb
    got = {(r[0], r[1]): r[2] for r in sb.corr_pairs(df, cols).collect()}
    assert len(got) == 65 * 64 // 2
    for i, j in [(0, 1), (0, 64), (3, 40), (63, 64)]:
        ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert got[(cols[i], cols[j])] == pytest.approx(np.corrcoef(x[ok, i], x[ok, j])[0, 1], abs=1e-9)


def test_auc_of_classes_of_four_billion(spark):
    from lendscope.operators import evaluation as ev

    big = 4_000_000_000
    roc = spark.createDataFrame([(0.9, big // 2, 0, big // 2, 0, big, big, 0.0, 0.5), (0.5, big // 2, big // 2, big, big // 2, big, big, 0.5, 1.0),
                                 (0.1, 0, big // 2, big, big, big, big, 1.0, 1.0)],
                                "threshold double, pos long, neg long, tp long, fp long, P long, N long, fpr double, tpr double")
    assert ev.ranking_metrics(roc).first()["auc"] == pytest.approx(0.875, abs=1e-12)


def test_chi_square_of_four_billion_rows_and_its_tail(spark):
    from pyspark.sql import functions as F

    from lendscope.functions.pvalues import chi2_sf, sql_chi2_sf
    # upper tails of chi-square: (x, dof, value), values from published tables and the Poisson sum
    known = [(3.841458820694124, 1, 0.05), (18.307038053275146, 10, 0.05), (124.34211340400407, 100, 0.05),
             (553.1268089, 500, 0.05), (499.3333779, 500, 0.5), (1999.333, 2000, 0.5), (2105.15, 2000, 0.05), (100736.0, 100000, 0.05), (3000.0, 2000, 0.0),
             (5000.0, 300, 0.0), (100.0, 2000, 1.0)]
    df = spark.createDataFrame([(float(x), k, p) for x, k, p in known], "x double, k int, p double")
    for r in df.select("p", chi2_sf(F.col("x"), F.col("k")).alias("q"), "x", "k").collect():
        assert r["q"] == pytest.approx(r["p"], abs=2e-4), r
    import duckdb
    for x, k, p in known:
        assert duckdb.execute(f"SELECT {sql_chi2_sf(repr(float(x)), repr(k))}").fetchall()[0][0] == pytest.approx(p, abs=2e-4)


def test_woe_and_metrics_independent_of_partitioning(book):
    from lendscope.operators import woe
    from lendscope.sources.loan_book import CATEGORICAL_FEATURES, NUMERIC_FEATURES

    def run(df):
        m = woe.fit_woe(df, "target", NUMERIC_FEATURES, CATEGORICAL_FEATURES)
        ivs = sorted(tuple(r) for r in woe.iv_summary(m).collect())
        met = sorted(tuple(r) for r in ev.all_metrics(df, "pd_fine", "target").collect())
        return ivs, met

    assert run(book.repartition(1)) == run(book.repartition(6, "region"))


def test_wide_categorical_is_joined_and_not_collected(spark):
    from lendscope.operators import woe

    df = spark.range(14_000).select(F.col("id").alias("k"), (F.col("id") % 7_000).cast("string").alias("shop"),
                                    (F.col("id") % 2).cast("string").alias("kind"), (F.col("id") % 3 == 0).cast("int").alias("target"))
    m = woe.fit_woe(df, "target", [], ["shop", "kind"])
    assert m.needs_join("shop") and not m.needs_join("kind")
    assert set(m.features) == {"shop", "kind"} and "shop" not in m.lookup()
    got = woe.encode(df, m, keep=["k", "shop"])
    want = {r["category"]: r["woe"] for r in m.table.where("feature = 'shop'").select("category", "woe").collect()}
    rows = got.collect()
    assert len(rows) == 14_000 and all(r["shop_woe"] == want[r["shop"]] for r in rows)
