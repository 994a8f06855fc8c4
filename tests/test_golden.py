"""Goldens from published results (tests/golden/*.csv, fixed values).

The published scorecard lists, per (feature, bin), the row count and the
default rate of the 1,000-row training table.  Expanding those counts back
into rows reproduces the inputs of WoE/IV and of the chi-square tests for
every feature, so the published WoE, IV and chi-square / Cramér's V values
can be recomputed by our operators.
"""

import csv
import os

import pytest
from pyspark.sql import functions as F

from lendscope.operators import hypothesis as H
from lendscope.operators import woe

GOLD = os.path.join(os.path.dirname(__file__), "golden")


def _card():
    with open(os.path.join(GOLD, "published_scorecard_bins.csv"), newline="", encoding="utf-8") as fh:
        return list(csv.DictReader(fh))


def _expanded(spark, feature):
    """Rows (level, target) for one feature from its published bins."""
    rows = []
    for r in _card():
        if r["Feature"] != feature:
            continue
        n = int(r["Count"])
        ev = round(n * float(r["Default_Rate"]))
        rows.append((r["Bin"], n, ev))
    data = []
    for b, n, ev in rows:
        data += [(b, 1)] * ev + [(b, 0)] * (n - ev)
    return spark.createDataFrame(data, f"`{feature}` string, target int"), rows


FEATURES = sorted({r["Feature"] for r in _card()})


@pytest.mark.parametrize("feature", FEATURES)
def test_woe_matches_published(spark, feature):
    df, rows = _expanded(spark, feature)
    assert df.count() == 1000
    m = woe.fit_woe(df, "target", [], [feature])
    got = {r["category"]: r["woe"] for r in woe.woe_table(m).collect()}
    want = {r["Bin"]: float(r["WoE"]) for r in _card() if r["Feature"] == feature}
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-4), (feature, k)


# Published IVs of the five strongest features.
PUBLISHED_IV = {"checking_account": 0.6613, "credit_history": 0.2923, "duration_months": 0.2439,
                "savings_account": 0.1888, "purpose": 0.1654}


@pytest.mark.parametrize("feature", sorted(PUBLISHED_IV))
def test_iv_matches_published(spark, feature):
    df, _ = _expanded(spark, feature)
    m = woe.fit_woe(df, "target", [], [feature])
    iv = woe.iv_summary(m).collect()[0]["iv"]
    assert iv == pytest.approx(PUBLISHED_IV[feature], abs=1e-4)


def _published_chi():
    with open(os.path.join(GOLD, "published_chi_square.csv"), newline="", encoding="utf-8") as fh:
        return list(csv.reader(fh))[1:]


@pytest.mark.parametrize("row", _published_chi(), ids=lambda r: r[0])
def test_chi_square_matches_published(spark, row):
    feature, chi2, p, reject, v, label = row
    df, _ = _expanded(spark, feature)
    r = H.chi_square(df, [feature], "target").collect()[0]
    assert r["chi2"] == pytest.approx(float(chi2), abs=0.006)
    assert r["cramers_v"] == pytest.approx(float(v), abs=1e-4)
    assert r["p_value"] == pytest.approx(float(p), abs=1.5e-4)
    assert r["reject_h0"] == (reject == "True")
    assert r["effect_size"] == label


def test_yates_only_on_two_by_two(spark):
    """foreign_worker (2 levels): corrected 5.82, not the plain 6.74."""
    df, _ = _expanded(spark, "foreign_worker")
    r = H.chi_square(df, ["foreign_worker"], "target").collect()[0]
    assert r["dof"] == 1 and r["chi2"] == pytest.approx(5.82, abs=0.006)
