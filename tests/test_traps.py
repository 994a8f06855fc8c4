"""Hand-sized edge cases for the semantic traps of the workflow."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendscope.operators import evaluation as ev
from lendscope.operators import hypothesis as H
from lendscope.operators import prep, woe
from lendscope.operators.binning import fit_quantile_edges
from lendscope.operators.ordered import exact_quantiles
from lendscope.operators.threshold import arange_grid, optimal_threshold, threshold_curve


# T1 --------------------------------------------------------------------
def test_encode_target_rules(spark):
    df = spark.createDataFrame([(1,), (0,), (1,)], "target int")
    once = prep.encode_target(df)
    assert [r[0] for r in once.collect()] == [0, 1, 0]
    assert [r[0] for r in prep.encode_target(once).collect()] == [1, 0, 1]
    two = spark.createDataFrame([(1,), (2,)], "target int")
    assert [r[0] for r in prep.encode_target(two).collect()] == [0, 1]
    with pytest.raises(ValueError):
        prep.encode_target(spark.createDataFrame([(1,), (1,)], "target int"))
    with pytest.raises(ValueError):
        prep.encode_target(spark.createDataFrame([(3,), (1,)], "target int"))
    kept = prep.encode_target(spark.createDataFrame([(0,), (1,)], "target int"), good_value=0)
    assert [r[0] for r in kept.collect()] == [0, 1]


# T3 --------------------------------------------------------------------
@pytest.mark.parametrize("limit", [None, 0])
def test_exact_quantiles_match_linear_rule(spark, limit):
    rng = np.random.default_rng(5)
    vals = np.concatenate([rng.integers(0, 20, 300), rng.normal(size=200)]).astype(float)
    df = spark.createDataFrame([(float(v),) for v in vals], "v double").withColumn("g", F.lit("a"))
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r["q_idx"]: r["q"] for r in exact_quantiles(df, ["g"], "v", probs, local_limit=limit).collect()}
    want = np.percentile(vals, [p * 100 for p in probs])
    for j, w in enumerate(want):
        assert got[j] == pytest.approx(w, rel=1e-12, abs=1e-12)


# T4 --------------------------------------------------------------------
def test_duplicate_edges_are_merged(spark):
    rows = [(1,)] * 31 + [(2,)] * 20 + [(3,)] * 15 + [(4,)] * 35   # 101 rows: positions 0, 25, ..., 100
    df = spark.createDataFrame(rows, "rate int")
    e = fit_quantile_edges(df, ["rate"], bins=4)
    assert e.edges["rate"] == [1.0, 2.0, 4.0]   # quartile edges 1, 1, 2, 4, 4 -> two bins
    assert e.n_bins("rate") == 2


# T5, T6, T7 ------------------------------------------------------------
def test_smoothing_rounding_and_totals(spark):
    rows = [("a", 1), ("a", 0), ("a", 0), ("b", 1), ("b", 1), ("b", 0), (None, 1), ("a", None)]
    df = spark.createDataFrame(rows, "c string, target int")
    t = {r["category"]: r for r in woe.woe_table(woe.fit_woe(df, "target", [], ["c"])).collect()}
    te = 4                     # sum of targets over all rows, null-feature row included
    tne = 8 - te               # len(df) - events: the null target counts as non-event
    pe_a, pne_a = (1 + 0.5) / (te + 0.5), (2 + 0.5) / (tne + 0.5)
    assert t["a"]["total"] == 3 and t["a"]["events"] == 1      # count of non-null targets
    assert t["a"]["woe"] == round(math.log(pe_a / pne_a), 4)
    assert None not in t
    enc = woe.encode(df, woe.fit_woe(df, "target", [], ["c"]), keep=["c"])
    vals = {r["c"]: r["c_woe"] for r in enc.collect()}
    assert vals["a"] == t["a"]["woe"]          # rounded WoE is the encoding
    assert vals[None] is None                  # unmatched -> null in batch encode


# T9, T10 ---------------------------------------------------------------
def test_new_applicant_clamping(spark):
    train = spark.createDataFrame([(float(x), x % 3 == 0, "k" if x % 2 else "m") for x in range(1, 101)],
                                  "x double, y boolean, cat string").withColumn("target", F.col("y").cast("int"))
    m = woe.fit_woe(train, "target", ["x"], ["cat"], bins=4)
    look = m.lookup()["x"]
    new = spark.createDataFrame([(-5.0, "k"), (1000.0, "zz"), (float("nan"), None), (None, "m"), (30.0, "m")],
                                "x double, cat string")
    out = woe.encode(new, m, keep=["x", "cat"], new_data=True).collect()
    first, last = look[1], look[max(look)]
    assert out[0]["x_woe"] == first            # below the lowest edge -> first bin
    assert out[1]["x_woe"] == last             # above the top -> last bin
    assert out[2]["x_woe"] == last             # NaN -> last bin
    assert out[3]["x_woe"] == last             # null treated like NaN
    assert out[1]["cat_woe"] == 0.0 and out[2]["cat_woe"] == 0.0   # unseen / missing category
    batch = woe.encode(new, m, keep=["x"]).collect()
    assert batch[0]["x_woe"] is None and batch[1]["x_woe"] is None   # batch: no clamping


# T11 -------------------------------------------------------------------
def _mwu_reference(x, y):
    """Textbook U of x with midranks, tie-corrected normal approximation,
    continuity 0.5, two-sided."""
    allv = np.concatenate([x, y])
    order = np.argsort(allv, kind="mergesort")
    ranks = np.empty(len(allv))
    sv = allv[order]
    i = 0
    while i < len(sv):
        j = i
        while j + 1 < len(sv) and sv[j + 1] == sv[i]:
            j += 1
        ranks[order[i:j + 1]] = (i + j) / 2 + 1
        i = j + 1
    n1, n2 = len(x), len(y)
    u1 = ranks[:n1].sum() - n1 * (n1 + 1) / 2
    _, t = np.unique(allv, return_counts=True)
    n = n1 + n2
    s = math.sqrt(n1 * n2 / 12 * ((n + 1) - (t ** 3 - t).sum() / (n * (n - 1))))
    z = (max(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / s
    return u1, min(1.0, math.erfc(z / math.sqrt(2)))


def test_mann_whitney_matches_textbook(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 30, 140).astype(float)
    y = rng.integers(3, 33, 60).astype(float)
    df = spark.createDataFrame([(float(v), 0) for v in x] + [(float(v), 1) for v in y], "v double, target int")
    r = H.mann_whitney(df, ["v"], "target").collect()[0]
    u, p = _mwu_reference(x, y)
    assert r["u_stat"] == pytest.approx(u, abs=0.005)
    assert r["p_value"] == pytest.approx(p, abs=1e-4)
    assert r["effect_r"] == pytest.approx(1 - 2 * u / (140 * 60), abs=1e-4)


# T14 -------------------------------------------------------------------
def test_threshold_grid_and_first_minimum(spark):
    g = arange_grid(0.05, 0.80, 0.01)
    assert len(g) == 75 and g[0] == 0.05
    assert g[25] == 0.05 + 25 * ((0.05 + 0.01) - 0.05)
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.2, 0)], "p double, y int")
    curve = {r["threshold"]: r for r in threshold_curve(df, "p", "y").collect()}
    # the grid value labelled 0.5 is 0.5000000000000001: p = 0.5 does not reach it
    assert curve[0.5]["FN"] == 1 and curve[0.5]["FP"] == 0
    assert curve[0.49]["FN"] == 0 and curve[0.49]["FP"] == 1
    best = optimal_threshold(threshold_curve(df, "p", "y")).collect()[0]
    assert best["optimal_threshold"] == 0.21 and best["min_cost"] == 1.0   # ties -> lowest threshold


# T15, T16 --------------------------------------------------------------
def test_degenerate_and_perfect_scores(spark):
    same = spark.createDataFrame([(0.3, 1), (0.3, 0), (0.3, 0)], "p double, y int")
    r = ev.auc_ks_gini(same, "p", "y").collect()[0]
    assert r["roc_auc"] == 0.5 and r["ks_statistic"] == 0.0
    perfect = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.2, 0)], "p double, y int")
    r = ev.auc_ks_gini(perfect, "p", "y").collect()[0]
    assert r["roc_auc"] == 1.0 and r["ks_statistic"] == 1.0 and r["gini"] == 1.0


def _ap_reference(y, p):
    order = np.argsort(-p, kind="mergesort")
    ys, ps = y[order], p[order]
    ap, tp, fp, last_r = 0.0, 0, 0, 0.0
    P = y.sum()
    i = 0
    while i < len(ps):
        j = i
        while j < len(ps) and ps[j] == ps[i]:
            tp += ys[j]
            fp += 1 - ys[j]
            j += 1
        r = tp / P
        ap += (r - last_r) * tp / (tp + fp)
        last_r = r
        i = j
    return ap


def test_average_precision_is_a_step_sum(spark):
    rng = np.random.default_rng(11)
    p = np.round(rng.random(300), 2)
    y = (rng.random(300) < p).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, y int")
    r = ev.ranking_metrics(ev.roc_table(df, "p", "y")).collect()[0]
    assert r["ap"] == pytest.approx(_ap_reference(y, p), abs=1e-12)


# T17 -------------------------------------------------------------------
def test_hl_dof_fixed_when_bins_merge(spark):
    rows = [(0.1, 0)] * 50 + [(0.1, 1)] * 5 + [(0.4, 1)] * 20 + [(0.4, 0)] * 25
    df = spark.createDataFrame(rows, "p double, y int")
    r = ev.hosmer_lemeshow(df, "p", "y").collect()[0]
    assert r["n_groups"] < 10 and r["dof"] == 8


# T2 --------------------------------------------------------------------
def test_half_even_rounding(spark):
    from lendscope.functions.numeric import np_round
    df = spark.createDataFrame([(0.125,), (2.5,), (3.5,), (1.015,)], "x double")
    got = [r[0] for r in df.select(np_round("x", 2)).collect()]
    assert got == [float(np.round(v, 2)) for v in (0.125, 2.5, 3.5, 1.015)]
    got0 = [r[0] for r in df.select(np_round("x", 0)).collect()]
    assert got0 == [0.0, 2.0, 4.0, 1.0]


def test_many_level_categorical_encodes_by_join(spark, monkeypatch):
    from lendscope.operators import woe as W
    rows = [(f"l{i % 40}", int(i % 3 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "c string, target int")
    m = W.fit_woe(df, "target", [], ["c"])
    lit = {r["c"]: r["c_woe"] for r in W.encode(df, m, keep=["c"]).collect()}
    monkeypatch.setattr(W, "MAP_LITERAL_LIMIT", 10)
    new = spark.createDataFrame([("l1",), ("zz",)], "c string")
    joined = {r["c"]: r["c_woe"] for r in W.encode(df, m, keep=["c"]).collect()}
    assert joined == lit
    clamp = {r["c"]: r["c_woe"] for r in W.encode(new, m, keep=["c"], new_data=True).collect()}
    assert clamp["zz"] == 0.0 and clamp["l1"] == lit["l1"]


def test_constant_numeric_feature_is_skipped(spark):
    df = spark.createDataFrame([(5.0, i % 2) for i in range(20)], "x double, target int")
    m = woe.fit_woe(df, "target", ["x"], [])
    assert m.edges.n_bins("x") == 0
    assert woe.woe_table(m).count() == 0 and m.features == []


def test_bin_without_events_is_smoothed(spark):
    rows = [("a", 0)] * 10 + [("b", 1)] * 5 + [("b", 0)] * 5
    t = {r["category"]: r for r in woe.woe_table(woe.fit_woe(spark.createDataFrame(rows, "c string, target int"),
                                                             "target", [], ["c"])).collect()}
    assert t["a"]["events"] == 0
    assert t["a"]["woe"] == round(math.log((0.5 / 5.5) / (10.5 / 15.5)), 4)


def test_band_floors_are_inclusive(spark):
    from lendscope.functions.labels import score_band, score_decision
    df = spark.createDataFrame([(s,) for s in (449, 450, 549, 550, 649, 650, 749, 750, -3)], "s int")
    got = [(r[0], r[1]) for r in df.select(score_band(F.col("s")), score_decision(F.col("s"))).collect()]
    assert got == [("Very High Risk", "Auto Decline"), ("High Risk", "Decline"), ("High Risk", "Decline"),
                   ("Medium Risk", "Manual Review"), ("Medium Risk", "Manual Review"), ("Low Risk", "Approve"),
                   ("Low Risk", "Approve"), ("Very Low Risk", "Auto Approve"), ("Very High Risk", "Auto Decline")]


def test_policy_with_no_approved_loans_is_empty(spark):
    from lendscope.operators import risk
    df = spark.createDataFrame([(i, 0.3, 100.0) for i in range(50)], "k long, p double, e double")
    sc = risk.policy_scenarios(thresholds=(0.1,))
    losses = risk.simulate_losses(df, "k", "p", "e", sc, n_sims=20).collect()
    assert len(losses) == 20 and all(r["loss"] == 0.0 for r in losses)


def test_key_value_sink_roundtrip(spark, tmp_path):
    from lendscope.sources.io import write_key_values
    df = spark.createDataFrame([("var_99", 1.5), ("n_simulations", 10000.0)], "metric string, value double")
    out = str(tmp_path / "kv")
    write_key_values(df, out)
    back = spark.read.schema("k string, v double").csv(out).collect()
    assert sorted((r["k"], r["v"]) for r in back) == [("n_simulations", 10000.0), ("var_99", 1.5)]


def test_prep_helpers(spark):
    from lendscope.sources import german_credit as gc
    df = spark.createDataFrame([(1, 2, None), (2, None, 1)], "laufkont int, verm int, kredit int")
    r = prep.rename_columns(df, gc.COLUMN_MAPPING)
    assert r.columns == ["checking_account", "property", "target"]
    filled = prep.with_defaults(r, gc.HIDDEN_DEFAULTS).collect()
    assert [x["property"] for x in filled] == [2, 2] and all(x["other_debtors"] == 1 for x in filled)
    dec = prep.decode(r, "checking_account", gc.LABEL_MAPS["checking_account"]).collect()
    assert [x["checking_account_label"] for x in dec] == ["< 0 DM (negative)", "0–200 DM"]
    num, cat = prep.feature_groups(r, gc.NUMERIC_COLS, gc.CATEGORICAL_COLS)
    assert num == [] and cat == ["checking_account", "property"]


def test_beta_parameters():
    from lendscope.operators.risk import beta_params
    a, b = beta_params(0.45, 0.10)
    assert a == pytest.approx(10.6875) and b == pytest.approx(13.0625)
    a2, b2 = beta_params(0.45, 0.10, adjust=True)
    assert a2 == pytest.approx(10.6975) and b2 == pytest.approx(13.0725)


def test_approximate_edges_are_close(spark):
    rng = np.random.default_rng(2)
    vals = rng.normal(size=2000)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    exact = fit_quantile_edges(df, ["x"], 10).edges["x"]
    approx = fit_quantile_edges(df, ["x"], 10, method="approx").edges["x"]
    assert len(exact) == len(approx) == 11
    ranks = np.searchsorted(np.sort(vals), approx) / len(vals)
    assert np.all(np.abs(ranks - np.linspace(0, 1, 11)) <= 0.002)
