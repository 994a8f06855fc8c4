"""Bracketed selection: numpy's linear quantiles, ties, gaps, bad sketches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendscope.operators import binning, quantiles

PROBS = [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.75, 0.999, 1.0]


def frame(spark, cols, groups=None):
    rows = list(zip(*[[None if v is None else float(v) for v in c] for c in cols.values()], groups or [0] * len(next(iter(cols.values())))))
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols) + ", g int").repartition(5)


def want(values, probs=PROBS):
    v = np.array([x for x in values if x is not None and x == x])
    return list(np.quantile(v, probs)) if len(v) else None


def cases():
    rng = np.random.default_rng(11)
    return {"smooth": rng.normal(size=30_000), "ties": rng.integers(0, 7, 5000), "hot": np.where(rng.random(5000) < 0.4, 3.0, rng.normal(size=5000)),
            "few": [3.0, 1.0, 2.0], "one": [5.0], "odd": [None, float("nan"), 1.0, 4.0, None, -2.0], "zipf": rng.zipf(1.5, 8000).clip(max=10**6)}


@pytest.mark.parametrize("limit", [None, 0, 10**6])
@pytest.mark.parametrize("name", list(cases()))
def test_equals_numpy(spark, name, limit):
    v = cases()[name]
    got = quantiles.select(frame(spark, {"x": list(v)}), ["x"], PROBS, local_limit=limit).values[(), "x"]
    assert got == pytest.approx(want(v), rel=1e-14)


def test_groups_and_columns_together(spark):
    rng = np.random.default_rng(2)
    n = 9000
    g = [None if i % 3 == 2 else int(i % 3) for i in range(n)]
    cols = {"a": list(rng.normal(size=n)), "b": [None if k == 1 else float(rng.integers(0, 50)) for k in g]}
    got = quantiles.select(frame(spark, cols, g), ["a", "b"], PROBS, ["g"], {"n": F.count, "top": F.max})
    for key in (0, 1, None):
        for c in cols:
            own = [x for x, k in zip(cols[c], g) if k == key]
            if want(own) is None:
                assert ((key,), c) not in got.values
            else:
                assert got.values[(key,), c] == pytest.approx(want(own), rel=1e-14)
                assert got.extra[(key,), c] == {"n": len(own), "top": max(own)}


@pytest.mark.parametrize("bad", ["none", "far", "narrow"])
def test_a_wrong_sketch_costs_scans_not_results(spark, monkeypatch, bad):
    v = list(np.random.default_rng(5).normal(size=4000))
    brackets = {"none": [], "far": [(50.0, 60.0)], "narrow": [(0.0, 0.0001)]}[bad]
    monkeypatch.setattr(quantiles, "sketch", lambda *a: ({((), "x"): list(brackets)}, {}))
    assert quantiles.select(frame(spark, {"x": v}), ["x"], PROBS).values[(), "x"] == pytest.approx(want(v), rel=1e-14)


def test_slots_hold_few_rows_and_count_all(spark):
    n = 300_000
    df = spark.range(n).select((F.col("id") * 7919 % n).cast("double").alias("x"), (F.col("id") % 2).alias("y"))
    got = quantiles.select(df, ["x"], [0.1 * i for i in range(11)], sums={"events": F.col("y")})
    assert got.slots.count() < n / 100   # not a table of distinct values
    t = got.slots.agg(F.sum("rows").alias("n"), F.sum("events").alias("e")).first()
    assert (t["n"], t["e"]) == (n, n // 2)
    assert got.values[(), "x"] == pytest.approx(want(range(n), [0.1 * i for i in range(11)]))


def test_bin_table_from_slots_equals_direct_counts(spark):
    rng = np.random.default_rng(8)
    df = frame(spark, {"x": list(np.round(rng.gamma(2, 50, 6000), 1)), "y": [None if i % 9 == 0 else float(i % 13) for i in range(6000)]})
    got = {(r["feature"], r["bin_id"]): r["n"] for r in binning.quantile_bin_table(df, ["x", "y"], 10).collect()}
    edges = binning.fit_quantile_edges(df, ["x", "y"], 10)
    direct = binning.quantile_bin_table(df, ["x", "y"], 10, edges=edges)
    assert got == {(r["feature"], r["bin_id"]): r["n"] for r in direct.collect()}
    assert sum(n for (f, _), n in got.items() if f == "x") == 6000


def test_empty_and_infinite(spark):
    assert quantiles.select(frame(spark, {"x": [1.0]}).where("false"), ["x"], PROBS).values == {}
    v = [float("-inf"), 1.0, 2.0, 3.0, float("inf")]
    assert quantiles.select(frame(spark, {"x": v}), ["x"], [0.0, 0.25, 0.5, 1.0]).values[(), "x"] == [v[0], 1.0, 2.0, v[4]]
