"""C: profiling of the loan book."""

from __future__ import annotations

from ..functions.numeric import np_round
from ..operators import stats_basic as sb
from ..sources.loan_book import CATEGORICAL_FEATURES, NUMERIC_FEATURES, loan_book
from .registry import query
from .sql_parts import numeric_long, with_loan_book

NUM, CAT = NUMERIC_FEATURES, CATEGORICAL_FEATURES
BOOK_COLS = ["loan_id", "credit_amount", "acct_balance", "n_lines", "total_qty", "priority", "segment",
             "region", "pm", "u", "target", "raw_target", "pd", "pd_fine"]


@query("basic_info", with_loan_book(f"""
SELECT CAST(COUNT(*) AS BIGINT) AS n_rows, CAST({len(BOOK_COLS)} AS BIGINT) AS n_cols,
       CAST({' + '.join(f'SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)' for c in BOOK_COLS)} AS BIGINT) AS total_nulls,
       AVG(CAST(target AS DOUBLE)) AS default_rate,
       CAST(SUM(CASE WHEN target = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_good,
       CAST(SUM(CASE WHEN target = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_default
FROM loan_book"""))
def basic_info_q(spark, sf_dir):
    """Rows, columns, nulls, default rate and class counts in one aggregate."""
    return sb.basic_info(loan_book(spark, sf_dir), "target")


@query("value_share", with_loan_book("""
SELECT target AS value, CAST(COUNT(*) AS BIGINT) AS n, COUNT(*) * 100.0 / (SELECT COUNT(*) FROM loan_book) AS share_pct
FROM loan_book GROUP BY target"""))
def value_share_q(spark, sf_dir):
    """Class counts and shares of the target."""
    return sb.value_share(loan_book(spark, sf_dir, materialize=True), "target")


@query("default_rate_by_category", with_loan_book(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS level, CAST(COUNT(*) AS BIGINT) AS n, "
    f"AVG(CAST(target AS DOUBLE)) AS default_rate FROM loan_book GROUP BY {c}" for c in CAT)))
def default_rate_by_category_q(spark, sf_dir):
    """C4: rows and default rate per level of every categorical feature."""
    return sb.default_rate_by_category(loan_book(spark, sf_dir), "target", CAT)


@query("class_means_diff", with_loan_book(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, ROUNDX(AVG(CASE WHEN target = 0 THEN {c} END), 2) AS mean_good, "
    f"ROUNDX(AVG(CASE WHEN target = 1 THEN {c} END), 2) AS mean_default, "
    f"ROUNDX(AVG(CASE WHEN target = 1 THEN {c} END) - AVG(CASE WHEN target = 0 THEN {c} END), 2) AS difference "
    f"FROM loan_book" for c in NUM)))
def class_means_diff_q(spark, sf_dir):
    """Mean of each numeric feature for goods and defaults, and the difference."""
    return sb.class_means_diff(loan_book(spark, sf_dir), "target", NUM)


CORR_COLS = NUM + ["target"]
_pairs = [(a, b) for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:]]


@query("corr_matrix", with_loan_book(" UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, ROUNDX(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS r FROM loan_book"
    for a, b in _pairs)))
def corr_matrix_q(spark, sf_dir):
    """Pearson r for every pair of numeric features and the target."""
    out = sb.corr_pairs(loan_book(spark, sf_dir), CORR_COLS)
    return out.select("feature_a", "feature_b", np_round("r", 6).alias("r"))


@query("describe", with_loan_book(f"""
SELECT feature, CAST(COUNT(x) AS BIGINT) AS count, ROUNDX(AVG(x), 2) AS mean, ROUNDX(STDDEV_SAMP(x), 2) AS std,
       ROUNDX(MIN(x), 2) AS min, ROUNDX(quantile_cont(x, 0.25), 2) AS q25, ROUNDX(quantile_cont(x, 0.5), 2) AS q50,
       ROUNDX(quantile_cont(x, 0.75), 2) AS q75, ROUNDX(MAX(x), 2) AS max
FROM ({numeric_long()}) t GROUP BY feature"""))
def describe_q(spark, sf_dir):
    """Count, mean, std, min, exact quartiles and max per numeric feature."""
    return sb.describe(loan_book(spark, sf_dir, materialize=True), NUM)


@query("iqr_outliers", with_loan_book(f"""
, qq AS (SELECT feature, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM ({numeric_long()}) t GROUP BY feature)
, b AS (SELECT feature, q1, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM qq)
SELECT b.feature, b.q1, b.q3, ROUNDX(b.lo, 2) AS lower_bound, ROUNDX(b.hi, 2) AS upper_bound,
       CAST(SUM(CASE WHEN t.x < b.lo OR t.x > b.hi THEN 1 ELSE 0 END) AS BIGINT) AS outliers,
       ROUNDX(SUM(CASE WHEN t.x < b.lo OR t.x > b.hi THEN 1 ELSE 0 END) * 100.0 / COUNT(*), 2) AS outlier_pct
FROM ({numeric_long()}) t JOIN b ON t.feature = b.feature GROUP BY b.feature, b.q1, b.q3, b.lo, b.hi"""))
def iqr_outliers_q(spark, sf_dir):
    """Quartiles, 1.5 IQR fences and outlier counts per numeric feature."""
    return sb.iqr_outliers(loan_book(spark, sf_dir, materialize=True), NUM)


def _hist_sql(col: str, bins: int) -> str:
    x = f"CAST({col} AS DOUBLE)"
    case = " ".join(f"WHEN x < e{i} THEN {i - 1}" for i in range(1, bins))
    edge_cols = ", ".join(f"{i} * ((mx - mn) / {bins}) + mn AS e{i}" for i in range(bins)) + f", mx AS e{bins}"
    arr = "[" + ", ".join(f"e{i}" for i in range(bins + 1)) + "]"
    return f"""
, mm AS (SELECT MIN({x}) AS mn, MAX({x}) AS mx FROM loan_book)
, ed AS (SELECT {edge_cols} FROM mm)
, hb AS (SELECT target, CASE {case} ELSE {bins - 1} END AS bin, x FROM (SELECT target, {x} AS x FROM loan_book) s, ed)
, hc AS (SELECT target, bin, COUNT(*) AS n FROM hb GROUP BY target, bin)
, cn AS (SELECT target, COUNT(*) AS n_class FROM loan_book GROUP BY target)
SELECT hc.target, CAST(hc.bin AS INTEGER) AS bin, {arr}[hc.bin + 1] AS lo, {arr}[hc.bin + 2] AS hi, CAST(hc.n AS BIGINT) AS n,
       hc.n / (cn.n_class * ({arr}[hc.bin + 2] - {arr}[hc.bin + 1])) AS density
FROM hc JOIN cn ON hc.target = cn.target, ed"""


@query("histogram_by_class", with_loan_book(_hist_sql("credit_amount", 20)))
def histogram_by_class_q(spark, sf_dir):
    """Equal-width histogram of the credit amount per class, with densities."""
    return sb.histogram_by_class(loan_book(spark, sf_dir, materialize=True), "credit_amount", "target", 20)


@query("histograms_by_class", with_loan_book(f"""
, t AS ({numeric_long(extra='target')})
, mm AS (SELECT feature, CASE WHEN MIN(x) = MAX(x) THEN MIN(x) - 0.5 ELSE MIN(x) END AS mn,
                CASE WHEN MIN(x) = MAX(x) THEN MAX(x) + 0.5 ELSE MAX(x) END AS mx FROM t WHERE x IS NOT NULL GROUP BY feature)
, b AS (SELECT t.feature, t.target, mn, mx, len(list_filter(range(1, 20), lambda i: x >= i * ((mx - mn) / 20) + mn)) AS bin
        FROM t JOIN mm ON t.feature = mm.feature WHERE x IS NOT NULL)
, c AS (SELECT feature, target, bin, mn, mx, COUNT(*) AS n FROM b GROUP BY ALL)
, e AS (SELECT feature, target, bin, n, SUM(n) OVER (PARTITION BY feature, target) AS n_class, bin * ((mx - mn) / 20) + mn AS lo,
               CASE WHEN bin = 19 THEN mx ELSE (bin + 1) * ((mx - mn) / 20) + mn END AS hi FROM c)
SELECT feature, target, CAST(bin AS INTEGER) AS bin, lo, hi, CAST(n AS BIGINT) AS n, CAST(n AS DOUBLE) / (n_class * (hi - lo)) AS density FROM e"""))
def histograms_by_class_q(spark, sf_dir):
    """C8 for every numeric column: equal-width histograms per class with densities."""
    return sb.histograms_by_class(loan_book(spark, sf_dir), NUM, "target", 20)


@query("box_stats", with_loan_book(f"""
, t AS ({numeric_long(extra='target')})
, qq AS (SELECT feature, target, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
                quantile_cont(x, 0.75) AS q3 FROM t GROUP BY feature, target)
SELECT qq.feature, qq.target, CAST(COUNT(t.x) AS BIGINT) AS n, MIN(t.x) AS min, qq.q1, qq.median, qq.q3, MAX(t.x) AS max,
       ROUNDX(AVG(t.x), 6) AS mean,
       MIN(CASE WHEN t.x >= qq.q1 - 1.5 * (qq.q3 - qq.q1) THEN t.x END) AS whisker_lo,
       MAX(CASE WHEN t.x <= qq.q3 + 1.5 * (qq.q3 - qq.q1) THEN t.x END) AS whisker_hi
FROM t JOIN qq ON t.feature = qq.feature AND t.target = qq.target
GROUP BY qq.feature, qq.target, qq.q1, qq.median, qq.q3"""))
def box_stats_q(spark, sf_dir):
    """Five-number summary, mean and whiskers per numeric feature and class."""
    out = sb.box_stats(loan_book(spark, sf_dir, materialize=True), NUM, "target")
    return out.withColumn("mean", np_round("mean", 6))
