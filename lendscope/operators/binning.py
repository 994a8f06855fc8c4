"""Quantile (D1) and equal-width (D2) binning with right-closed bins.

Bins are ``(lo, hi]`` with the lowest edge included in the first bin, the
pandas ``qcut``/``cut`` convention (Spark's ``Bucketizer`` is ``[lo, hi)``,
so it is not used).  Edges are fitted once, collected as fitted state
(at most features x (bins + 1) numbers) and applied as a generated ``CASE``
so that encoding is a narrow, codegen'd projection with no join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import CacheScope, unpivot_numeric
from .quantiles import Selection, select


def qcut_probs(bins: int) -> list[float]:
    return [i / bins for i in range(bins + 1)]


@dataclass
class BinEdges:
    """Distinct sorted edges per numeric feature (duplicates merged)."""

    edges: dict[str, list[float]] = field(default_factory=dict)

    def n_bins(self, feature: str) -> int:
        return max(0, len(self.edges.get(feature, [])) - 1)

    def to_rows(self) -> list[tuple[str, int, float, float]]:
        rows = []
        for f, e in self.edges.items():
            for i in range(1, len(e)):
                rows.append((f, i, e[i - 1], e[i]))
        return rows

    def to_df(self, spark) -> DataFrame:
        schema = "feature string, bin_id int, lo double, hi double"
        return spark.createDataFrame(self.to_rows(), schema)

    def bin_id(self, feature: str, x: Column, clamp: bool = False) -> Column:
        """Bin number 1..m of ``x``.

        ``clamp=False`` (fit/batch): values outside [e0, em], null and NaN
        give null.  ``clamp=True`` (new applicants): at or below the first
        upper edge -> 1, anything else unmatched (above the top, NaN, null)
        -> m.
        """
        e = self.edges.get(feature, [])
        m = len(e) - 1
        if m < 1:
            return F.lit(None).cast("int")
        xd = x.cast("double")
        if clamp:
            expr = None
            for i in range(1, m + 1):
                expr = F.when(xd <= e[i], i) if expr is None else expr.when(xd <= e[i], i)
            return expr.otherwise(m)
        expr = F.when(xd.isNull() | F.isnan(xd) | (xd < e[0]), F.lit(None))
        for i in range(1, m + 1):
            expr = expr.when(xd <= e[i], i)
        return expr.otherwise(F.lit(None)).cast("int")


def fit_quantile_edges(df: DataFrame, numeric_cols: list[str], bins: int = 10,
                       local_limit: int | None = None, method: str = "exact",
                       accuracy: int = 100_000) -> BinEdges:
    """Quantile edges for all numeric columns in one job.

    ``method="exact"`` (default): linear interpolation as pandas ``qcut``.
    ``method="approx"``: one pass of ``percentile_approx`` (edges are data
    values within rank error 1/accuracy) -- an opt-in when exact edges are not
    required."""
    if not numeric_cols:
        return BinEdges({})
    probs = qcut_probs(bins)
    if method == "approx":
        r = df.agg(*[F.percentile_approx(F.col(c).cast("double"), probs, accuracy).alias(c)
                     for c in numeric_cols]).first()
        return BinEdges({c: sorted(set(float(v) for v in (r[c] or []))) for c in numeric_cols})
    with CacheScope():
        return edges_of(select(df, numeric_cols, probs, local_limit=local_limit), numeric_cols)


def edges_of(selection: Selection, numeric_cols: list[str]) -> BinEdges:
    """The distinct quantiles of each column."""
    return BinEdges({f: sorted({float(v) for v in selection.values.get(((), f), [])}) for f in numeric_cols})


def quantile_bin_table(df: DataFrame, numeric_cols: list[str], bins: int = 10,
                       edges: BinEdges | None = None) -> DataFrame:
    """D1 as a table: (feature, bin_id, lo, hi, n) with row counts per bin.
    The slot counts of the selection give the bin counts, too."""
    spark = df.sparkSession
    with CacheScope():
        if edges is None:
            found = select(df, numeric_cols, qcut_probs(bins))
            edges, dist = edges_of(found, numeric_cols), found.slots.withColumnRenamed("rep", "value")
        else:
            dist = unpivot_numeric(df, numeric_cols).withColumn("rows", F.lit(1))
        bin_of = None
        for f in numeric_cols:
            b = edges.bin_id(f, F.col("value"))
            bin_of = F.when(F.col("feature") == f, b) if bin_of is None else bin_of.when(F.col("feature") == f, b)
        counts = dist.where(bin_of.isNotNull()).groupBy("feature", bin_of.alias("bin_id")).agg(
            F.sum("rows").alias("n"))
        out = edges.to_df(spark).join(counts, ["feature", "bin_id"], "left").select(
            "feature", "bin_id", "lo", "hi", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")).persist()
        out.count()   # small result, materialized before the distinct counts are released
    return out


def equal_width_edges(x_min: Column, x_max: Column, bins: int) -> list[Column]:
    """``pd.cut(bins=k)`` edges as columns of a one-row frame: linspace
    (min, max) with the first edge lowered by 0.1 % of the range."""
    step = (x_max - x_min) / bins
    edges = [F.lit(i) * step + x_min for i in range(bins)] + [x_max]
    edges[0] = x_min - (x_max - x_min) * 0.001
    return edges


def equal_width_bin(x: Column, edges: list[Column]) -> Column:
    """Right-closed bin number 1..k of x, given edge columns."""
    k = len(edges) - 1
    expr = None
    for i in range(1, k + 1):
        cond = x <= edges[i]
        expr = F.when(cond, i) if expr is None else expr.when(cond, i)
    return expr.otherwise(F.lit(None)).cast("int")


def with_equal_width_bins(df: DataFrame, col: str, bins: int, out: str = "bucket") -> DataFrame:
    """Add ``out`` (1..bins), ``<out>_lo``, ``<out>_hi``.  The min/max are
    fitted state (one aggregate row) and enter the plan as literals."""
    mm = df.agg(F.min(col).alias("mn"), F.max(col).alias("mx")).first()
    if mm is None or mm["mn"] is None:
        return df.select("*", F.lit(None).cast("int").alias(out),
                         F.lit(None).cast("double").alias(f"{out}_lo"), F.lit(None).cast("double").alias(f"{out}_hi"))
    edges = equal_width_edges(F.lit(float(mm["mn"])), F.lit(float(mm["mx"])), bins)
    b = equal_width_bin(F.col(col), edges)
    arr = F.array(*edges)
    return df.select("*", b.alias(out), F.element_at(arr, b).alias(f"{out}_lo"),
                     F.element_at(arr, b + 1).alias(f"{out}_hi"))
