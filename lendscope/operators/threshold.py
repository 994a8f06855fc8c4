"""Cost-optimal decision threshold.

Rows are bucketed by how many grid thresholds their score reaches (a
``CASE`` on the raw grid values), counted per bucket, and the FN/FP counts
of every grid threshold come from running sums over at most len(grid)+1
rows.  The first minimum wins (lowest threshold on ties).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import np_round


def arange_grid(start: float, stop: float, step: float) -> list[float]:
    """Float grid with NumPy ``arange`` semantics: n = ceil((stop-start)/step)
    values start + j * ((start + step) - start)."""
    n = max(0, math.ceil((stop - start) / step))
    delta = (start + step) - start
    return [start + j * delta for j in range(n)]


def grid_bucket(p, grid: list[float]):
    """Number of grid values t with p >= t (grid ascending)."""
    expr = None
    for j, t in enumerate(grid):
        expr = F.when(p < t, j) if expr is None else expr.when(p < t, j)
    return expr.otherwise(len(grid))


def threshold_curve(df: DataFrame, score: str, label: str, fn_cost: float = 5.0, fp_cost: float = 1.0,
                    grid: list[float] | None = None) -> DataFrame:
    """(threshold, FN, FP, total_cost) for every grid value, ``p >= t``."""
    grid = grid or arange_grid(0.05, 0.80, 0.01)
    spark = df.sparkSession
    p, y = F.col(score).cast("double"), F.col(label)
    counts = df.where(p.isNotNull()).groupBy(grid_bucket(p, grid).alias("b")).agg(
        F.sum((y == 1).cast("bigint")).alias("pos"), F.sum((y == 0).cast("bigint")).alias("neg"))
    # one extra grid row for "reaches every threshold" so totals are complete
    g = spark.createDataFrame([(j, t) for j, t in enumerate(grid)] + [(len(grid), None)], "j int, t double")
    # len(grid) + 1 rows: the running sums below stay in one small task
    w = Window.orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w_all = Window.orderBy("j").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    j = g.join(counts, g.j == counts.b, "left")
    cur = j.select("j", "t", F.sum(F.coalesce("pos", F.lit(0))).over(w).alias("FN"),
                   F.sum(F.coalesce("neg", F.lit(0))).over(w).alias("neg_le"),
                   F.sum(F.coalesce("neg", F.lit(0))).over(w_all).alias("n_neg")).where(F.col("j") < len(grid))
    fp = F.coalesce(F.col("n_neg"), F.lit(0)) - F.col("neg_le")
    return cur.select(np_round("t", 2).alias("threshold"), F.col("FN").cast("bigint").alias("FN"),
                      fp.cast("bigint").alias("FP"),
                      (F.col("FN") * fn_cost + fp * fp_cost).alias("total_cost"), "j")


def optimal_threshold(curve: DataFrame) -> DataFrame:
    return curve.orderBy("total_cost", "j").limit(1).select(
        F.col("threshold").alias("optimal_threshold"), F.col("total_cost").alias("min_cost"))
