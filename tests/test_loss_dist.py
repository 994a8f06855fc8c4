"""Loss distribution without draws against an exact convolution, the moments
in closed form, and awkward books."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendscope.operators import loss_dist as ld
from lendscope.operators import risk


def book(spark, pds, eads):
    rows = [(i, None if p is None else float(p), None if e is None else float(e)) for i, (p, e) in enumerate(zip(pds, eads))]
    return spark.createDataFrame(rows, "loan_id long, pd double, ead double").repartition(3)


def beta_cdf_cells(a, b, edges):
    """Mass of Beta(a, b) in the cells of ``edges``, by a fine midpoint sum."""
    x = (np.arange(20_000) + 0.5) / 20_000
    w = x ** (a - 1) * (1 - x) ** (b - 1)
    c = np.concatenate([[0], np.cumsum(w) / w.sum()])
    return np.diff(np.interp(np.clip(edges, 0, 1), np.linspace(0, 1, 20_001), c))


def exact_cdf(pds, eads, a, b, cells=1 << 14):
    """CDF of the loss on a lattice: the transform of every loan's own mass
    function, multiplied."""
    top = sum(eads) * 1.02
    unit = top / cells
    product = np.ones(cells // 2 + 1, dtype=complex)
    for p, e in zip(pds, eads):
        k = int(e / unit) + 3
        mass = np.zeros(cells)
        mass[:k] = p * beta_cdf_cells(a, b, (np.arange(k + 1) - 0.5) * unit / e)
        mass[0] += 1 - p
        product *= np.fft.rfft(mass)
    return unit * (np.arange(cells) + 0.5), np.cumsum(np.fft.irfft(product, cells))


@pytest.mark.parametrize("seed,n,spread", [(1, 300, 0.3), (2, 250, 1.0)])
def test_equals_the_exact_convolution(spark, seed, n, spread):
    rng = np.random.default_rng(seed)
    pds, eads = rng.uniform(0.02, 0.9, n), np.exp(rng.normal(8, spread, n))
    base = risk.base_scenario()
    m = ld.LossModel(book(spark, pds, eads), "pd", "ead", [base])
    x, cdf = exact_cdf(pds, eads, base.lgd_a, base.lgd_b)
    got = m.distribution(240).orderBy("i").toPandas()
    assert np.abs(got["cdf"].to_numpy() - np.interp(got["loss"], x, cdf)).max() < 2e-3
    r = m.metrics().first()
    for q, v, es in ((0.95, r.var_95, r.cvar_95), (0.99, r.var_99, r.cvar_99)):
        want = np.interp(q, cdf[cdf < 1 - 1e-9], x[cdf < 1 - 1e-9])
        mass = np.diff(cdf, prepend=0)
        beyond = (x * mass)[x > want].sum() / mass[x > want].sum()
        assert abs(v - want) < 0.02 * r.std and abs(es - beyond) < 0.03 * r.std
    assert r.ec_99 == pytest.approx(r.var_99 - r.el)
    large = (eads > ld.LARGE * r.std).sum()
    assert 0 < large < n  # banded loans and single ones


def test_moments_are_those_of_the_loans(spark):
    rng = np.random.default_rng(3)
    pds, eads = rng.uniform(0, 1, 2000), np.exp(rng.normal(5, 2, 2000))
    scen = [risk.base_scenario(), *risk.stress_scenarios(), *risk.policy_scenarios(), risk.Scenario("flat", lgd_const=0.4)]
    df = book(spark, pds, eads)
    m = ld.LossModel(df, "pd", "ead", scen)
    frames = {r["scenario"]: r for r in m.frames.collect()}
    assert set(frames) == {s.name for s in scen}
    for s in scen:
        l1, l2 = sum(w * x for x, w in ld.scenario_nodes(s)), sum(w * x * x for x, w in ld.scenario_nodes(s))
        keep = pds <= (2 if s.pd_max is None else s.pd_max)
        p, e = np.minimum(pds[keep] * s.pd_mult, 1), eads[keep]
        assert frames[s.name].el == pytest.approx((p * e).sum() * l1, rel=1e-10)
        assert frames[s.name].sd == pytest.approx(math.sqrt((e * e * (p * l2 - p * p * l1 * l1)).sum()), rel=1e-9)
    # the series itself has these moments
    d = m.distribution(2400).toPandas()
    for name, g in d.groupby("scenario"):
        g = g.sort_values("loss")
        step = (g["loss"].iloc[1] - g["loss"].iloc[0])
        f = frames[name]
        if f.lo < 0:
            continue
        mean = (g["loss"] * g["density"]).sum() * step
        assert mean == pytest.approx(f.el, rel=1e-6)
        assert math.sqrt(((g["loss"] - mean) ** 2 * g["density"]).sum() * step) == pytest.approx(f.sd, rel=1e-5)


def test_quadrature_keeps_beta_moments():
    for a, b in ((10.7, 13.1), (1.3, 0.8), risk.beta_params(0.25, 0.1, adjust=True)):
        nodes = ld.beta_nodes(a, b)
        want = 1.0
        for k in range(1, 2 * ld.NODES):
            want *= (a + k - 1) / (a + b + k - 1)
            assert sum(w * x ** k for x, w in nodes) == pytest.approx(want, rel=1e-11)


def test_agrees_with_the_simulation(spark):
    rng = np.random.default_rng(4)
    df = book(spark, rng.uniform(0.05, 0.6, 1500), np.exp(rng.normal(8, 0.8, 1500)))
    want = risk.risk_metrics(risk.simulate_losses(df, "loan_id", "pd", "ead", [risk.base_scenario()], 20_000)).first()
    got = ld.LossModel(df, "pd", "ead", [risk.base_scenario()]).metrics().first()
    for c in ("el", "var_95", "var_99", "cvar_95", "cvar_99"):
        assert abs(got[c] - want[c]) < 0.08 * got["std"]


def test_awkward_books(spark):
    rows = [(0.2, 100.0)] * 400
    odd = [(None, 5.0), (0.3, None), (0.5, 0.0), (0.5, -3.0), (-0.1, 9.0), (0.0, 50.0)]
    clean = ld.LossModel(book(spark, *zip(*rows)), "pd", "ead", [risk.base_scenario()]).metrics().first()
    mixed = ld.LossModel(book(spark, *zip(*(rows + odd))), "pd", "ead", [risk.base_scenario()]).metrics().first()
    assert mixed.var_99 == pytest.approx(clean.var_99, rel=1e-9) and mixed.cvar_95 == pytest.approx(clean.cvar_95, rel=1e-9)
    sure = ld.LossModel(book(spark, [1.0] * 300, [10.0] * 300), "pd", "ead", [risk.base_scenario()]).metrics().first()
    assert sure.el == pytest.approx(300 * 10 * 0.45) and sure.std == pytest.approx(math.sqrt(300) * 10 * 0.10, rel=1e-6)
    for pds, eads in (([], []), ([None], [1.0]), ([0.0, 0.0], [3.0, 4.0])):
        m = ld.LossModel(book(spark, pds, eads) if pds else book(spark, [0.5], [1.0]).where("false"), "pd", "ead", [risk.base_scenario()])
        assert m.metrics().count() == 0 and m.distribution().count() == 0
    few = ld.LossModel(book(spark, [0.3], [100.0]), "pd", "ead", [risk.base_scenario(), risk.policy_scenarios()[0]])
    assert [r["scenario"] for r in few.metrics().collect()] == ["base"]


def test_banding_keeps_no_row_of_a_loan(spark):
    """The aggregate's size depends on the spread of exposures, not on loans."""
    df = spark.range(200_000).select(((F.col("id") % 97) / 100.0).alias("pd"), (F.lit(1000.0) + F.col("id") % 9000).alias("ead"))
    bands = ld.loss_bands(df, "pd", "ead", [(1.0, math.inf)])
    assert bands.count() <= (math.log(10) / math.log(ld.RATIO) + 3) * (ld.PD_BANDS + 1)
