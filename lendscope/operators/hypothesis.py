"""Statistical feature tests (E1-E8), all features per job.

* normality screen: Jarque-Bera from population skewness/kurtosis
  (replaces a Shapiro-Wilk test on a 300-row sample), p = exp(-JB/2);
* Mann-Whitney U of the class-0 sample, tie-corrected normal
  approximation with 0.5 continuity correction, two-sided; ranks are
  midranks computed from per-value class counts with distributed prefix
  sums, so no task ever sorts a whole column;
* contingency tables and chi-square independence, Yates-corrected when
  dof = 1, Cramér's V from the corrected statistic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import effect_size
from ..functions.numeric import np_round
from ..functions.pvalues import chi2_sf, normal_sf
from .ordered import prefix_sums, unpivot_numeric

ALPHA = 0.05


def normality_screen(df: DataFrame, numeric_cols: list[str], alpha: float = ALPHA) -> DataFrame:
    """(feature, n, skewness, kurtosis, jb, p_value, normal, test)."""
    long = unpivot_numeric(df, numeric_cols).where(F.col("value").isNotNull())
    m = long.groupBy("feature").agg(F.count("value").alias("n"), F.skewness("value").alias("skewness"),
                                    F.kurtosis("value").alias("kurtosis"))
    jb = F.col("n") / 6.0 * (F.col("skewness") ** 2 + F.col("kurtosis") ** 2 / 4.0)
    p = F.exp(-jb / 2.0)
    return m.select("feature", "n", np_round("skewness", 4).alias("skewness"), np_round("kurtosis", 4).alias("kurtosis"),
                    np_round(jb, 4).alias("jb"), np_round(p, 4).alias("p_value"), (p >= alpha).alias("normal"),
                    F.when(p >= alpha, "t-test").otherwise("Mann-Whitney U").alias("test"))


def mann_whitney(df: DataFrame, numeric_cols: list[str], target: str, alpha: float = ALPHA,
                 local_limit: int | None = None) -> DataFrame:
    """(feature, n0, n1, u_stat, p_value, reject_h0, effect_r, effect_size)."""
    long = unpivot_numeric(df, numeric_cols, ids=[target]).where(
        F.col("value").isNotNull() & F.col(target).isin(0, 1))
    y = F.col(target)
    counts = long.groupBy("feature", "value").agg(
        F.sum((y == 0).cast("bigint")).alias("c0"), F.sum((y == 1).cast("bigint")).alias("c1")
    ).withColumn("cnt", F.col("c0") + F.col("c1"))
    pre = prefix_sums(counts, ["feature"], "value", ["cnt"], local_limit=local_limit)
    midrank = (F.col("cum_cnt") - F.col("cnt")).cast("double") + (F.col("cnt") + 1) / 2.0
    t = F.col("cnt").cast("double")
    per_feature = pre.groupBy("feature").agg(
        F.sum(F.col("c0") * midrank).alias("r0"),
        F.sum("c0").alias("n0"), F.sum("c1").alias("n1"),
        F.sum(t * t * t - t).alias("tie"))
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    n = n0 + n1
    u0 = F.col("r0") - n0 * (n0 + 1) / 2.0
    mu = n0 * n1 / 2.0
    sigma = F.sqrt(n0 * n1 / 12.0 * ((n + 1) - F.col("tie") / (n * (n - 1))))
    u_big = F.greatest(u0, n0 * n1 - u0)
    z = (u_big - mu - 0.5) / sigma
    p = F.least(normal_sf(z) * 2.0, F.lit(1.0))
    r = F.lit(1.0) - u0 * 2.0 / (n0 * n1)
    return per_feature.select(
        "feature", "n0", "n1", np_round(u0, 2).alias("u_stat"), np_round(p, 4).alias("p_value"),
        (p < alpha).alias("reject_h0"), np_round(r, 4).alias("effect_r"), effect_size(r).alias("effect_size"))


def contingency(df: DataFrame, categorical_cols: list[str], target: str) -> DataFrame:
    """(feature, level, n_good, n_default, total, pct_good, pct_default)
    with row percentages; one pass for all features."""
    long = df.select(F.col(target).alias("_y"), *[F.col(c).cast("string").alias(c) for c in categorical_cols]) \
        .unpivot(["_y"], categorical_cols, "feature", "level").where(F.col("level").isNotNull())
    y = F.col("_y")
    c = long.groupBy("feature", "level").agg(
        F.sum((y == 0).cast("bigint")).alias("n_good"), F.sum((y == 1).cast("bigint")).alias("n_default"))
    tot = F.col("n_good") + F.col("n_default")
    return c.select("feature", "level", "n_good", "n_default", tot.alias("total"),
                    np_round(F.col("n_good") * 100.0 / tot, 2).alias("pct_good"),
                    np_round(F.col("n_default") * 100.0 / tot, 2).alias("pct_default"))


def chi_square(df: DataFrame, categorical_cols: list[str], target: str, alpha: float = ALPHA) -> DataFrame:
    """(feature, chi2, dof, p_value, reject_h0, cramers_v, effect_size).

    One pass: the (feature, level) counts also carry the row count of every
    level (null levels and null targets included), which gives n = all rows
    for Cramér's V.  The table is small (levels x 2); totals come from a
    window over it.  Yates' correction applies to 2x2 tables only; V uses
    the corrected statistic."""
    long = df.select(F.col(target).alias("_y"), *[F.col(c).cast("string").alias(c) for c in categorical_cols]) \
        .unpivot(["_y"], categorical_cols, "feature", "level")
    y = F.col("_y")
    raw = long.groupBy("feature", "level").agg(
        F.sum((y == 0).cast("bigint")).alias("n_good"), F.sum((y == 1).cast("bigint")).alias("n_default"),
        F.count(F.lit(1)).alias("n_rows"))
    w = Window.partitionBy("feature")
    ct = raw.withColumn("_all_rows", F.sum("n_rows").over(w)).where(F.col("level").isNotNull()) \
        .withColumn("total", F.col("n_good") + F.col("n_default"))
    cells = ct.select(
        "feature", "level", "n_good", "n_default", "total", "_all_rows",
        F.sum("total").over(w).alias("n"), F.sum("n_good").over(w).alias("c0"),
        F.sum("n_default").over(w).alias("c1"), F.count(F.lit(1)).over(w).alias("r"))
    c_classes = (F.when(F.col("c0") > 0, 1).otherwise(0) + F.when(F.col("c1") > 0, 1).otherwise(0))
    cells = cells.withColumn("k", c_classes).withColumn("dof", (F.col("r") - 1) * (F.col("k") - 1))

    def term(obs, col_total):
        e = F.col("total").cast("double") * F.col(col_total) / F.col("n")
        d = F.abs(F.col(obs) - e)
        d = F.when(F.col("dof") == 1, d - F.least(F.lit(0.5), d)).otherwise(d)
        return F.when(e > 0, d * d / e).otherwise(0.0)

    stat = cells.groupBy("feature").agg(
        F.sum(term("n_good", "c0") + term("n_default", "c1")).alias("chi2"),
        F.first("dof").alias("dof"), F.first("r").alias("r"), F.first("k").alias("k"),
        F.first("_all_rows").alias("n_all"))
    kmin = F.least(F.col("r"), F.col("k"))
    raw_out = stat.where(F.col("dof") >= 1).select(
        "feature", F.col("chi2").alias("_chi2"), F.col("dof").alias("_dof"),
        chi2_sf(F.col("chi2"), F.col("dof")).alias("_p"),
        F.sqrt(F.col("chi2") / (F.col("n_all").cast("double") * (kmin - 1))).alias("_v"))
    return raw_out.select(
        "feature", np_round("_chi2", 2).alias("chi2"), F.col("_dof").cast("bigint").alias("dof"),
        np_round("_p", 4).alias("p_value"), (F.col("_p") < alpha).alias("reject_h0"),
        np_round("_v", 4).alias("cramers_v"), effect_size(F.col("_v")).alias("effect_size"))


def confirmed_features(mw: DataFrame, chi: DataFrame) -> DataFrame:
    """Union of both tests' rows with the significance flag."""
    a = mw.select("feature", F.lit("mann_whitney").alias("test"), "p_value", "reject_h0")
    b = chi.select("feature", F.lit("chi_square").alias("test"), "p_value", "reject_h0")
    return a.unionByName(b)


def top_by_cramers_v(chi: DataFrame, k: int = 6) -> DataFrame:
    """Strongest significant categorical associations."""
    return chi.where("reject_h0").orderBy(F.desc("cramers_v"), "feature").limit(k)
