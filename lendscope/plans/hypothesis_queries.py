"""E: statistical feature tests on the loan book."""

from __future__ import annotations

from ..functions.labels import sql_effect_size
from ..functions.pvalues import sql_chi2_sf, sql_normal_sf
from ..operators import hypothesis as H
from ..sources.loan_book import CATEGORICAL_FEATURES, NUMERIC_FEATURES, loan_book
from .registry import query
from .sql_parts import numeric_long, with_loan_book

NUM, CAT = NUMERIC_FEATURES, CATEGORICAL_FEATURES


@query("normality_screen", with_loan_book(f"""
, t AS ({numeric_long()})
, mu AS (SELECT feature, AVG(x) AS m, COUNT(x) AS n FROM t WHERE x IS NOT NULL GROUP BY feature)
, mom AS (SELECT t.feature, mu.n, AVG((x - m) * (x - m)) AS m2, AVG((x - m) * (x - m) * (x - m)) AS m3,
                 AVG((x - m) * (x - m) * (x - m) * (x - m)) AS m4
          FROM t JOIN mu ON t.feature = mu.feature WHERE x IS NOT NULL GROUP BY t.feature, mu.n)
, s AS (SELECT feature, n, m3 / pow(m2, 1.5) AS sk, m4 / (m2 * m2) - 3 AS ku FROM mom)
, j AS (SELECT feature, n, sk, ku, n / 6.0 * (sk * sk + ku * ku / 4.0) AS jb FROM s)
SELECT feature, CAST(n AS BIGINT) AS n, ROUNDX(sk, 4) AS skewness, ROUNDX(ku, 4) AS kurtosis, ROUNDX(jb, 4) AS jb,
       ROUNDX(exp(-jb / 2.0), 4) AS p_value, exp(-jb / 2.0) >= 0.05 AS normal,
       CASE WHEN exp(-jb / 2.0) >= 0.05 THEN 't-test' ELSE 'Mann-Whitney U' END AS test
FROM j"""))
def normality_screen_q(spark, sf_dir):
    """Jarque-Bera screen and the test it selects per numeric feature."""
    return H.normality_screen(loan_book(spark, sf_dir), NUM)


MW_SQL = f"""
, t AS ({numeric_long(extra='target')})
, c AS (SELECT feature, x, SUM(CASE WHEN target = 0 THEN 1 ELSE 0 END) AS c0,
               SUM(CASE WHEN target = 1 THEN 1 ELSE 0 END) AS c1, COUNT(*) AS cnt
        FROM t WHERE x IS NOT NULL AND target IN (0, 1) GROUP BY feature, x)
, rk AS (SELECT *, SUM(cnt) OVER (PARTITION BY feature ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - cnt
                   + (cnt + 1) / 2.0 AS midrank FROM c)
, f AS (SELECT feature, SUM(c0 * midrank) AS r0, CAST(SUM(c0) AS DOUBLE) AS n0, CAST(SUM(c1) AS DOUBLE) AS n1,
               SUM(CAST(cnt AS DOUBLE) * cnt * cnt - cnt) AS tie FROM rk GROUP BY feature)
, u AS (SELECT feature, n0, n1, r0 - n0 * (n0 + 1) / 2.0 AS u0, tie, n0 + n1 AS n FROM f)
, z AS (SELECT *, (greatest(u0, n0 * n1 - u0) - n0 * n1 / 2.0 - 0.5)
                  / sqrt(n0 * n1 / 12.0 * ((n + 1) - tie / (n * (n - 1)))) AS z,
               1.0 - u0 * 2.0 / (n0 * n1) AS r FROM u)
, p AS (SELECT *, least({sql_normal_sf('z')} * 2.0, 1.0) AS p FROM z)
"""
MW_SELECT = f"""SELECT feature, CAST(n0 AS BIGINT) AS n0, CAST(n1 AS BIGINT) AS n1, ROUNDX(u0, 2) AS u_stat,
       ROUNDX(p, 4) AS p_value, p < 0.05 AS reject_h0, ROUNDX(r, 4) AS effect_r, {sql_effect_size('r')} AS effect_size FROM p"""


@query("mann_whitney", with_loan_book(MW_SQL + MW_SELECT))
def mann_whitney_q(spark, sf_dir):
    """Mann-Whitney U of the goods, p-value and rank-biserial r per numeric feature."""
    return H.mann_whitney(loan_book(spark, sf_dir), NUM, "target")


CT_SQL = f"""
, ct AS ({" UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS level, SUM(CASE WHEN target = 0 THEN 1 ELSE 0 END) AS n_good, "
    f"SUM(CASE WHEN target = 1 THEN 1 ELSE 0 END) AS n_default FROM loan_book WHERE {c} IS NOT NULL GROUP BY {c}"
    for c in CAT)})
"""


@query("contingency", with_loan_book(CT_SQL + """
SELECT feature, level, CAST(n_good AS BIGINT) AS n_good, CAST(n_default AS BIGINT) AS n_default,
       CAST(n_good + n_default AS BIGINT) AS total, ROUNDX(n_good * 100.0 / (n_good + n_default), 2) AS pct_good,
       ROUNDX(n_default * 100.0 / (n_good + n_default), 2) AS pct_default FROM ct"""))
def contingency_q(spark, sf_dir):
    """Counts and row percentages of every categorical level by class."""
    return H.contingency(loan_book(spark, sf_dir), CAT, "target")


CHI_SQL = CT_SQL + f"""
, cells AS (SELECT *, n_good + n_default AS total, SUM(n_good + n_default) OVER (PARTITION BY feature) AS n,
                   SUM(n_good) OVER (PARTITION BY feature) AS c0, SUM(n_default) OVER (PARTITION BY feature) AS c1,
                   COUNT(*) OVER (PARTITION BY feature) AS r FROM ct)
, cells2 AS (SELECT *, (CASE WHEN c0 > 0 THEN 1 ELSE 0 END) + (CASE WHEN c1 > 0 THEN 1 ELSE 0 END) AS k FROM cells)
, cells3 AS (SELECT *, (r - 1) * (k - 1) AS dof, total * CAST(c0 AS DOUBLE) / n AS e0, total * CAST(c1 AS DOUBLE) / n AS e1,
                    abs(n_good - total * CAST(c0 AS DOUBLE) / n) AS d0, abs(n_default - total * CAST(c1 AS DOUBLE) / n) AS d1 FROM cells2)
, cells4 AS (SELECT *, CASE WHEN dof = 1 THEN d0 - least(0.5, d0) ELSE d0 END AS a0,
                    CASE WHEN dof = 1 THEN d1 - least(0.5, d1) ELSE d1 END AS a1 FROM cells3)
, st AS (SELECT feature, SUM(CASE WHEN e0 > 0 THEN a0 * a0 / e0 ELSE 0 END + CASE WHEN e1 > 0 THEN a1 * a1 / e1 ELSE 0 END) AS chi2,
                MIN(dof) AS dof, MIN(r) AS r, MIN(k) AS k FROM cells4 GROUP BY feature)
, st2 AS (SELECT *, sqrt(chi2 / ((SELECT COUNT(*) FROM loan_book) * (least(r, k) - 1))) AS v,
                 {sql_chi2_sf('chi2', 'dof')} AS p FROM st WHERE dof >= 1)
"""
CHI_SELECT = f"""SELECT feature, ROUNDX(chi2, 2) AS chi2, CAST(dof AS BIGINT) AS dof, ROUNDX(p, 4) AS p_value,
       p < 0.05 AS reject_h0, ROUNDX(v, 4) AS cramers_v, {sql_effect_size('v')} AS effect_size FROM st2"""


@query("chi_square", with_loan_book(CHI_SQL + CHI_SELECT))
def chi_square_q(spark, sf_dir):
    """Chi-square (Yates on 2x2), p-value and Cramer's V per categorical feature."""
    return H.chi_square(loan_book(spark, sf_dir), CAT, "target")


@query("confirmed_features", with_loan_book(MW_SQL + CHI_SQL.replace(", ct AS (", ", ct AS (", 1) + """
SELECT feature, 'mann_whitney' AS test, ROUNDX(p, 4) AS p_value, p < 0.05 AS reject_h0 FROM p
UNION ALL
SELECT feature, 'chi_square' AS test, ROUNDX(p, 4) AS p_value, p < 0.05 AS reject_h0 FROM st2"""))
def confirmed_features_q(spark, sf_dir):
    """Both tests' rows with p-values and the significance flag."""
    book = loan_book(spark, sf_dir, materialize=True)
    return H.confirmed_features(H.mann_whitney(book, NUM, "target"), H.chi_square(book, CAT, "target"))


@query("top_cramers_v", with_loan_book(CHI_SQL + """
SELECT feature, ROUNDX(chi2, 2) AS chi2, ROUNDX(v, 4) AS cramers_v FROM st2 WHERE p < 0.05
ORDER BY ROUNDX(v, 4) DESC, feature LIMIT 6"""))
def top_cramers_v_q(spark, sf_dir):
    """Strongest significant categorical associations by Cramer's V."""
    return H.top_by_cramers_v(H.chi_square(loan_book(spark, sf_dir), CAT, "target"), 6).select(
        "feature", "chi2", "cramers_v")
