"""SQL text fragments for the DuckDB oracle queries.

These mirror the Spark operators' definitions (edges by ``quantile_cont``,
right-closed bins, smoothed WoE) so that the two engines can be compared.
"""

from __future__ import annotations

from ..sources.loan_book import CATEGORICAL_FEATURES, NUMERIC_FEATURES, with_loan_book


def probs_list(bins: int) -> str:
    return "[" + ", ".join(repr(i / bins) for i in range(bins + 1)) + "]"


def numeric_long(src: str = "loan_book", cols=None, extra: str = "") -> str:
    cols = cols or NUMERIC_FEATURES
    extra_sel = f"{extra}, " if extra else ""
    return " UNION ALL ".join(
        f"SELECT {extra_sel}'{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM {src}" for c in cols)


def edges_cte(src: str = "loan_book", cols=None, bins: int = 10) -> str:
    """CTEs ``q_edges(feature, k, edge)`` and ``q_bins(feature, bin_id, lo, hi)``."""
    cols = cols or NUMERIC_FEATURES
    qs = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, quantile_cont(CAST({c} AS DOUBLE), {probs_list(bins)}) AS qs FROM {src}"
        for c in cols)
    return f"""
, q_raw AS ({qs})
, q_dist AS (SELECT DISTINCT feature, unnest(qs) AS edge FROM q_raw)
, q_edges AS (SELECT feature, edge, CAST(row_number() OVER (PARTITION BY feature ORDER BY edge) - 1 AS INTEGER) AS k FROM q_dist)
, q_bins AS (SELECT a.feature, b.k AS bin_id, a.edge AS lo, b.edge AS hi
             FROM q_edges a JOIN q_edges b ON a.feature = b.feature AND b.k = a.k + 1)
"""


def bin_join(long_src: str, x: str = "x") -> str:
    """Join condition assigning (lo, hi] bins, lowest edge included."""
    return (f"JOIN q_bins b ON b.feature = {long_src}.feature AND {long_src}.{x} <= b.hi "
            f"AND ({long_src}.{x} > b.lo OR (b.bin_id = 1 AND {long_src}.{x} >= b.lo))")


def woe_ctes(src: str = "loan_book", target: str = "target", num=None, cat=None, bins: int = 10,
             eps: float = 0.5) -> str:
    """CTE ``woe_t`` with the WoE table (unrounded columns *_raw too)."""
    num = NUMERIC_FEATURES if num is None else num
    cat = CATEGORICAL_FEATURES if cat is None else cat
    num_long = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, {target} AS y FROM {src}" for c in num)
    cat_long = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS bin_key, {target} AS y FROM {src}" for c in cat)
    parts = []
    if num:
        parts.append(f"""SELECT nl.feature, CAST(b.bin_id AS VARCHAR) AS bin_key, nl.y
                 FROM ({num_long}) nl LEFT {bin_join('nl')}""")
    if cat:
        parts.append(f"SELECT feature, bin_key, y FROM ({cat_long}) cl")
    union = " UNION ALL ".join(parts)
    num_in = ", ".join(f"'{c}'" for c in num) or "''"
    return (edges_cte(src, num, bins) if num else "") + f"""
, w_long AS ({union})
, w_cnt AS (SELECT feature, bin_key, SUM(y) AS events, COUNT(y) AS total, COUNT(*) AS n_rows
            FROM w_long GROUP BY feature, bin_key)
, w_tot AS (SELECT feature, SUM(events) AS te, SUM(n_rows) AS n FROM w_cnt GROUP BY feature
            HAVING SUM(events) > 0 AND SUM(n_rows) - SUM(events) > 0)
, w_pct AS (SELECT c.feature, c.bin_key, c.total, c.events, c.total - c.events AS non_events,
                   (c.events + {eps}) / (CAST(t.te AS DOUBLE) + {eps}) AS pe,
                   (c.total - c.events + {eps}) / (CAST(t.n - t.te AS DOUBLE) + {eps}) AS pne
            FROM w_cnt c JOIN w_tot t ON c.feature = t.feature WHERE c.bin_key IS NOT NULL)
, woe_t AS (SELECT p.feature,
                   CASE WHEN p.feature IN ({num_in}) THEN CAST(p.bin_key AS INTEGER) END AS bin_id,
                   CASE WHEN p.feature NOT IN ({num_in}) THEN p.bin_key END AS category,
                   CAST(p.total AS BIGINT) AS total, CAST(p.events AS BIGINT) AS events,
                   CAST(p.non_events AS BIGINT) AS non_events,
                   CAST(p.events AS DOUBLE) / p.total AS default_rate_raw,
                   p.pe, p.pne, ln(p.pe / p.pne) AS woe_raw, (p.pe - p.pne) * ln(p.pe / p.pne) AS iv_raw
            FROM w_pct p)
, woe_r AS (SELECT w.feature, w.bin_id, b.lo, b.hi, w.category, w.total, w.events, w.non_events,
                   ROUNDX(w.default_rate_raw, 4) AS default_rate, ROUNDX(w.pe, 4) AS pct_events,
                   ROUNDX(w.pne, 4) AS pct_non_events, ROUNDX(w.woe_raw, 4) AS woe, ROUNDX(w.iv_raw, 4) AS iv, w.iv_raw
            FROM woe_t w LEFT JOIN {'q_bins' if num else '(SELECT NULL AS feature, NULL AS bin_id, NULL AS lo, NULL AS hi)'} b
                 ON b.feature = w.feature AND b.bin_id = w.bin_id)
"""


__all__ = ["with_loan_book", "edges_cte", "woe_ctes", "numeric_long", "bin_join", "probs_list"]
