"""The Monte-Carlo draws: law of defaults and LGD, and what a run shuffles."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd

from lendscope.operators import risk


def block(pds, eads):
    return pd.DataFrame({"key": np.arange(len(pds)), "pd": pds, "ead": eads, "block": 7})


def losses(pdf, scenarios, n_sims=200_000):
    return risk._block_losses(pdf, scenarios, n_sims, 42, 1 << 17)


def test_default_probability_has_all_bits_of_the_pd():
    # below one part in 256, between two of them, on one, certain, impossible, unknown
    pds = [0.001, 0.1, 0.25, 1.0, 0.0, np.nan]
    for i, p in enumerate(pds):
        sc = risk.Scenario("s", lgd_const=1.0)
        rate = losses(block([p], [1.0]), [sc])["s"].mean()
        want = 0.0 if np.isnan(p) else p
        assert abs(rate - want) <= 5 * np.sqrt(want * (1 - want) / 200_000), (p, rate)


def test_lgd_follows_its_beta_law():
    for a, b in (risk.beta_params(0.45, 0.10), risk.beta_params(0.25, 0.10, adjust=True), (1.0, 1.0), (0.5, 0.5)):
        sc = risk.Scenario("s", lgd_a=a, lgd_b=b)
        got = np.sort(losses(block([1.0], [1.0]), [sc])["s"])
        mean, var = a / (a + b), a * b / (a + b) ** 2 / (a + b + 1)
        assert abs(got.mean() - mean) < 5 * np.sqrt(var / len(got))
        assert abs(got.var() / var - 1) < 0.02
        ref = np.sort(np.random.default_rng(1).beta(a, b, size=len(got)))
        both = np.concatenate([got, ref])
        gap = np.abs(np.searchsorted(got, both, "right") - np.searchsorted(ref, both, "right")).max() / len(got)
        assert gap < 1.95 * np.sqrt(2 / len(got))   # Kolmogorov-Smirnov, 1 in 1,000
        assert len(np.unique(got)) > 0.99 * len(got)


def test_inverse_of_the_beta_cdf():
    q, cdf, grid = risk.beta_inverse(2.0, 1.0)      # CDF x^2
    assert np.allclose(q, np.sqrt(np.arange(len(q)) / risk.LGD_CELLS), atol=1e-8)
    assert risk.beta_inverse(0.5, 3.0) is None


def test_shared_default_draws_are_made_once_and_chunks_join():
    rng = np.random.default_rng(3)
    pdf = block(rng.uniform(0, 0.5, 40), rng.uniform(1, 9, 40))
    one = [risk.Scenario(f"s{i}", lgd_const=0.5 * (i + 1)) for i in range(2)]
    got = losses(pdf, one, 5_000)
    assert np.allclose(got["s1"], 2 * got["s0"]) and got["s0"].std() > 0
    alone = losses(pdf, one[1:], 5_000)["s1"]
    assert np.array_equal(alone, got["s1"])
    policy = [risk.Scenario("none", lgd_const=1.0, pd_max=-1.0), risk.Scenario("all", lgd_const=0.5, pd_max=1.0)]
    by = losses(pdf, policy, 5_000)
    assert not by["none"].any() and np.array_equal(by["all"], got["s0"])


def test_partial_losses_do_not_grow_with_the_book(spark):
    df = spark.range(4_000).selectExpr("id AS k", "0.2D AS p", "1D AS e")
    sims = risk.simulate_losses(df, "k", "p", "e", [risk.Scenario("s", lgd_const=1.0)], n_sims=5, block_rows=1)
    plan = sims._jdf.queryExecution().optimizedPlan().toString()
    parts = int(re.search(r"RepartitionByExpression \[block#\d+ ASC NULLS FIRST\], (\d+)", plan).group(1))
    assert parts <= 16 * spark.sparkContext.defaultParallelism
    total = sum(r["loss"] for r in sims.collect())
    assert abs(total - 4_000) < 5 * np.sqrt(5 * 4_000 * 0.16)


def test_md5_losses_are_exact_and_spread(spark):
    import hashlib

    # none, certain, unknown, tiny, exactly a draw of loan 5, just above one of loan 6
    draw = lambda s, k: int(hashlib.md5(f"{s}-{k}".encode()).hexdigest()[:12], 16) / 2.0 ** 48
    loans = [(1, 0.0, 10.01), (2, 1.0, 1234567.89), (3, None, 5.0), (4, 1e-14, 7.0), (5, draw(3, 5), 20.0), (6, draw(2, 6) + 2.0 ** -48, 30.0),
             *[(k, k % 97 / 97, k * 3.37) for k in range(10, 300)]]
    df = spark.createDataFrame(loans, "k long, p double, e double").coalesce(1)
    out = risk.simulate_losses_md5(df, "k", "p", "e", 8)
    got = {r["sim_id"]: r["loss"] for r in out.collect()}
    want = {s: sum(round(e * 100) * 4500 for k, p, e in loans if p is not None and draw(s, k) < p) / 1e6 for s in range(8)}
    assert got == want
    assert risk.simulate_losses_md5(df.where("false"), "k", "p", "e", 8).count() == 0
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "conv(" not in plan and re.search(r"RepartitionByExpression \[k#", plan)


def test_rare_flags_are_all_found():
    rng = np.random.default_rng(4)
    for n in (0, 1, 7, 8, 9, 64, 1001, 32_000):
        for share in (0.0, 0.004, 0.3, 1.0):
            flags = rng.random(n) < share
            assert np.array_equal(risk._rare(flags), np.flatnonzero(flags))


def test_lgd_lines_give_the_inverse_cdf_over_all_bits():
    sc = risk.base_scenario()
    q, cdf, grid = risk.beta_inverse(sc.lgd_a, sc.lgd_b)
    u = np.concatenate([np.random.default_rng(2).integers(0, 1 << 32, 50_000), [0, 1, (1 << 32) - 1, 1 << 31, (1 << 31) - 1]]).astype(np.uint32)
    u = np.concatenate([u, [c << 18 for c in (16, 17, 8000, 16367)], [(c << 18) - 1 for c in (17, 8000, 16368)]]).astype(np.uint32)

    class Fixed:
        ints = staticmethod(lambda n, dtype: u)

    got = risk._draw_lgd(Fixed, len(u), risk._inverses([sc])[sc.lgd_a, sc.lgd_b], sc)
    inner = (u >> 18 >= risk.LGD_TAIL) & (u >> 18 < risk.LGD_CELLS - risk.LGD_TAIL)
    want = np.where(inner, np.interp((u + 0.5) / 2.0 ** 18, np.arange(risk.LGD_CELLS + 1), q), np.interp((u + 0.5) / 2.0 ** 32, cdf, grid))
    assert np.allclose(got, want, rtol=0, atol=1e-12)
