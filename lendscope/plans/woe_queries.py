"""D: binning, WoE/IV, selection, encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import sql_iv_strength
from ..functions.numeric import np_round
from ..operators import binning, woe
from ..operators.models import stratified_split
from ..operators.stats_basic import corr_pairs
from ..sources.loan_book import CATEGORICAL_FEATURES, NUMERIC_FEATURES, loan_book
from .registry import query
from .sql_parts import edges_cte, numeric_long, with_loan_book, woe_ctes

NUM, CAT = NUMERIC_FEATURES, CATEGORICAL_FEATURES
SPLIT_SEED = 42
# exact stratified 80/20 hold-out (operators.models.stratified_split) in SQL
SPLIT_SQL = f"""
, split_rank AS (SELECT lb.*, row_number() OVER (PARTITION BY target ORDER BY
                        ('0x' || substr(md5('{SPLIT_SEED}-' || CAST(loan_id AS VARCHAR)), 1, 15))::BIGINT, loan_id) AS _rn,
                        COUNT(*) OVER (PARTITION BY target) AS _nc FROM loan_book lb)
, train_book AS (SELECT * EXCLUDE (_rn, _nc) FROM split_rank WHERE _rn > round_even(_nc * 0.2, 0))
, new_book AS (SELECT * EXCLUDE (_rn, _nc) FROM split_rank WHERE _rn <= round_even(_nc * 0.2, 0))
"""


def holdout(book):
    """(train, new): the exact stratified 80/20 split of the book."""
    s = stratified_split(book, "loan_id", "target", 0.2, SPLIT_SEED)
    return s.where(~F.col("is_test")).drop("is_test"), s.where(F.col("is_test")).drop("is_test")


def fitted(spark, sf_dir):
    book = loan_book(spark, sf_dir, materialize=True)
    return book, woe.fit_woe(book, "target", NUM, CAT)


@query("qcut_bins", with_loan_book(edges_cte() + f"""
SELECT b.feature, b.bin_id, b.lo, b.hi, CAST(COUNT(nl.x) AS BIGINT) AS n
FROM q_bins b LEFT JOIN ({numeric_long()}) nl
  ON nl.feature = b.feature AND nl.x <= b.hi AND (nl.x > b.lo OR (b.bin_id = 1 AND nl.x >= b.lo))
GROUP BY b.feature, b.bin_id, b.lo, b.hi"""))
def qcut_bins(spark, sf_dir):
    """Exact decile edges (duplicates merged) and row counts per bin."""
    return binning.quantile_bin_table(loan_book(spark, sf_dir, materialize=True), NUM, bins=10)


@query("woe_table", with_loan_book(woe_ctes() + """
SELECT feature, bin_id, lo, hi, category, total, events, non_events, default_rate, pct_events,
       pct_non_events, woe, iv FROM woe_r"""))
def woe_table_q(spark, sf_dir):
    """WoE table of every feature (bins, counts, shares, WoE, IV)."""
    _, m = fitted(spark, sf_dir)
    return woe.woe_table(m)


IV_SUMMARY_SQL = woe_ctes() + f"""
, ivs AS (SELECT feature, ROUNDX(SUM(iv_raw), 4) AS iv FROM woe_r GROUP BY feature)
"""


@query("iv_summary", with_loan_book(IV_SUMMARY_SQL + f"""
SELECT feature, iv, {sql_iv_strength('iv')} AS strength FROM ivs"""))
def iv_summary_q(spark, sf_dir):
    """IV per feature with its strength label (the flagship query)."""
    _, m = fitted(spark, sf_dir)
    return woe.iv_summary(m)


@query("iv_selected", with_loan_book(IV_SUMMARY_SQL + """
SELECT feature, iv, iv >= 0.02 AS selected FROM ivs"""))
def iv_selected_q(spark, sf_dir):
    """IV per feature with the IV >= 0.02 selection flag."""
    _, m = fitted(spark, sf_dir)
    return woe.select_by_iv(woe.iv_summary(m), 0.02)


@query("iv_top_k", with_loan_book(IV_SUMMARY_SQL + """
SELECT feature, iv FROM ivs ORDER BY iv DESC, feature LIMIT 6"""))
def iv_top_k_q(spark, sf_dir):
    """The six features with the highest IV."""
    _, m = fitted(spark, sf_dir)
    return woe.top_k_by_iv(woe.iv_summary(m), 6).select("feature", "iv")


def _encode_sql_select(src_alias="lb", clamp=False, woe_src="woe_r", bins_src="q_bins"):
    """Per-feature scalar subqueries mapping a raw value to its WoE."""
    cols = []
    for f in NUM:
        if clamp:
            cond = (f"CAST({src_alias}.{f} AS DOUBLE) <= b.hi OR b.bin_id = (SELECT max(bin_id) FROM {bins_src} "
                    f"WHERE feature = '{f}')")
            cols.append(f"""COALESCE((SELECT w.woe FROM {bins_src} b JOIN {woe_src} w ON w.feature = b.feature AND w.bin_id = b.bin_id
                 WHERE b.feature = '{f}' AND ({cond}) ORDER BY b.bin_id LIMIT 1), 0.0) AS {f}_woe""")
        else:
            cols.append(f"""(SELECT w.woe FROM {bins_src} b JOIN {woe_src} w ON w.feature = b.feature AND w.bin_id = b.bin_id
                 WHERE b.feature = '{f}' AND CAST({src_alias}.{f} AS DOUBLE) <= b.hi
                   AND (CAST({src_alias}.{f} AS DOUBLE) > b.lo OR (b.bin_id = 1 AND CAST({src_alias}.{f} AS DOUBLE) >= b.lo))) AS {f}_woe""")
    for c in CAT:
        val = f"(SELECT w.woe FROM {woe_src} w WHERE w.feature = '{c}' AND w.category = CAST({src_alias}.{c} AS VARCHAR))"
        cols.append(f"COALESCE({val}, 0.0) AS {c}_woe" if clamp else f"{val} AS {c}_woe")
    return ",\n       ".join(cols)


@query("woe_encoded", with_loan_book(woe_ctes() + f"""
SELECT lb.loan_id, lb.target, {_encode_sql_select()} FROM loan_book lb"""))
def woe_encoded_q(spark, sf_dir):
    """WoE columns of every loan (unmatched values -> null)."""
    book, m = fitted(spark, sf_dir)
    return woe.encode(book, m, keep=["loan_id", "target"])


@query("woe_encode_new", with_loan_book(SPLIT_SQL + woe_ctes(src="train_book") + f"""
SELECT lb.loan_id, {_encode_sql_select(clamp=True)} FROM new_book lb"""))
def woe_encode_new_q(spark, sf_dir):
    """Fit on the 80 % training rows of the stratified split, encode the
    other 20 % as new applicants (numeric clamp to the outer bins, unseen
    category -> 0)."""
    train, new = holdout(loan_book(spark, sf_dir, materialize=True))
    m = woe.fit_woe(train, "target", NUM, CAT)
    return woe.encode(new, m, keep=["loan_id"], new_data=True)


WOE_COLS = [f + "_woe" for f in NUM + CAT]
_pairs = [(a, b) for i, a in enumerate(WOE_COLS) for b in WOE_COLS[i + 1:]]


def _corr_sql(above: float) -> str:
    return with_loan_book(woe_ctes() + f"""
, enc AS (SELECT {_encode_sql_select()} FROM loan_book lb)
, pairs AS ({" UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS r FROM enc" for a, b in _pairs)})
SELECT feature_a, feature_b, ROUNDX(r, 6) AS r FROM pairs WHERE abs(r) > {above}""")


@query("woe_corr_any", _corr_sql(0.02))
def woe_corr_any_q(spark, sf_dir):
    """D10 with a threshold that some pairs of WoE columns pass."""
    book, m = fitted(spark, sf_dir)
    return corr_pairs(woe.encode(book, m, keep=[]), WOE_COLS, min_abs=0.02).select("feature_a", "feature_b", np_round("r", 6).alias("r"))


@query("woe_corr_pairs", _corr_sql(0.7))
def woe_corr_pairs_q(spark, sf_dir):
    """Pairs of WoE columns whose |Pearson r| exceeds the threshold."""
    book, m = fitted(spark, sf_dir)
    enc = woe.encode(book, m, keep=[])
    return corr_pairs(enc, WOE_COLS, min_abs=0.7).select("feature_a", "feature_b", np_round("r", 6).alias("r"))
