"""ROC corners: the rule written out, unchanged area, the large path."""

import numpy as np
import pytest

from lendscope.operators import evaluation as ev


def corners(points):
    """points: (score, pos, neg) by falling score; kept scores."""
    out = []
    for i, (s, p, n) in enumerate(points):
        nxt = points[i + 1][1:] if i + 1 < len(points) else None
        if i == 0 or nxt is None or nxt != (p, n):
            out.append(s)
    return out


@pytest.mark.parametrize("limit", [None, 0])
@pytest.mark.parametrize("levels", [5, 400, 10**6])
def test_corners_of_groups(spark, levels, limit):
    rng = np.random.default_rng(levels)
    rows = [(["a", "b", None][int(g)], float(s) / levels, int(y)) for g, s, y in zip(rng.integers(0, 3, 900), rng.integers(0, levels, 900), rng.integers(0, 2, 900))]
    df = spark.createDataFrame(rows, "g string, s double, y int")
    roc = ev.roc_table(df, "s", "y", ["g"], local_limit=limit)
    got = ev.roc_corners(roc, ["g"])
    assert got.columns == roc.columns
    by = {}
    for r in got.collect():
        by.setdefault(r["g"], []).append(r)
    full = {r["g"]: r["auc"] for r in ev.ranking_metrics(roc, ["g"]).collect()}
    for g in ("a", "b", None):
        count = {}
        for k, s, y in rows:
            if k == g:
                p, n = count.get(s, (0, 0))
                count[s] = (p + y, n + 1 - y)
        kept = sorted(by[g], key=lambda r: -r["threshold"])
        assert [r["threshold"] for r in kept] == corners([(s, *count[s]) for s in sorted(count, reverse=True)])
        x, y = [0.0] + [r["fpr"] for r in kept], [0.0] + [r["tpr"] for r in kept]
        assert (x[-1], y[-1]) == (1.0, 1.0)
        assert sum((x[i + 1] - x[i]) * (y[i + 1] + y[i]) / 2 for i in range(len(x) - 1)) == pytest.approx(full[g], abs=1e-12)
    if levels == 10**6:
        assert got.count() < 0.75 * roc.count()


def test_corners_without_rows_or_with_one(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0)], "s double, y int")
    assert ev.roc_corners(ev.roc_table(df, "s", "y")).count() == 1
    assert ev.roc_corners(ev.roc_table(df.where("false"), "s", "y")).count() == 0


def test_roc_curve_query_has_every_distinct_score(spark):
    from lendscope.plans.eval_queries import models_long
    from lendscope.plans.registry import QUERIES
    from tests.conftest import SMOKE

    want = models_long(spark, SMOKE).where("score is not null").select("model", "score").distinct()
    got = QUERIES["roc_curve"](spark, SMOKE).select("model", "threshold")
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0
