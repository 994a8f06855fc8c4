"""Label ladders (``when`` chains) used across the workflow.

Fixed values (thresholds and labels as published by the reference workflow):
    IV strength: [0, .02) Useless, [.02, .10) Weak, [.10, .30) Medium,
                 [.30, .50) Strong, [.50, 9.99) Suspicious, otherwise Unknown
    KS grade:    < .20 Poor, < .40 Average, < .60 Good, otherwise Excellent
    effect size (|r| or V): < .1 Negligible, < .3 Small, < .5 Medium, otherwise Large
    VIF status:  < 5 OK, < 10 Moderate, otherwise High
    McFadden R2: < .1 Weak, < .2 Acceptable, < .4 Good, otherwise Excellent
    odds ratio direction: > 1 Increases risk, otherwise Decreases risk
    score bands (floor inclusive, band, decision):
        750 Very Low Risk / Auto Approve
        650 Low Risk / Approve
        550 Medium Risk / Manual Review
        450 High Risk / Decline
          0 Very High Risk / Auto Decline  (also below 0)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IV_LADDER = [(0.00, 0.02, "Useless"), (0.02, 0.10, "Weak"), (0.10, 0.30, "Medium"),
             (0.30, 0.50, "Strong"), (0.50, 9.99, "Suspicious")]
SCORE_BANDS = [(750, "Very Low Risk", "Auto Approve"), (650, "Low Risk", "Approve"),
               (550, "Medium Risk", "Manual Review"), (450, "High Risk", "Decline"),
               (0, "Very High Risk", "Auto Decline")]
BAND_ORDER = ["Very High Risk", "High Risk", "Medium Risk", "Low Risk", "Very Low Risk"]


def upper_ladder(x: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """``x < t1 -> l1, x < t2 -> l2, ..., else otherwise``."""
    expr = None
    for t, label in steps:
        expr = F.when(x < t, label) if expr is None else expr.when(x < t, label)
    return expr.otherwise(otherwise)


def iv_strength(iv: Column) -> Column:
    expr = None
    for lo, hi, label in IV_LADDER:
        cond = (iv >= lo) & (iv < hi)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise("Unknown")


def ks_grade(ks: Column) -> Column:
    return upper_ladder(ks, [(0.20, "Poor"), (0.40, "Average"), (0.60, "Good")], "Excellent")


def effect_size(x: Column) -> Column:
    return upper_ladder(F.abs(x), [(0.1, "Negligible"), (0.3, "Small"), (0.5, "Medium")], "Large")


def vif_status(v: Column) -> Column:
    return upper_ladder(v, [(5.0, "OK"), (10.0, "Moderate")], "High")


def mcfadden_grade(r2: Column) -> Column:
    return upper_ladder(r2, [(0.1, "Weak"), (0.2, "Acceptable"), (0.4, "Good")], "Excellent")


def or_direction(odds_ratio: Column) -> Column:
    return F.when(odds_ratio > 1, "Increases risk").otherwise("Decreases risk")


def score_band(score: Column) -> Column:
    expr = None
    for floor, band, _ in SCORE_BANDS[:-1]:
        expr = F.when(score >= floor, band) if expr is None else expr.when(score >= floor, band)
    return expr.otherwise(SCORE_BANDS[-1][1])


def score_decision(score: Column) -> Column:
    expr = None
    for floor, _, decision in SCORE_BANDS[:-1]:
        expr = F.when(score >= floor, decision) if expr is None else expr.when(score >= floor, decision)
    return expr.otherwise(SCORE_BANDS[-1][2])


def band_rank(band: Column) -> Column:
    """Fixed display order of bands (worst first)."""
    expr = None
    for i, b in enumerate(BAND_ORDER):
        expr = F.when(band == b, i) if expr is None else expr.when(band == b, i)
    return expr


def sql_case_upper(x: str, steps: list[tuple[float, str]], otherwise: str) -> str:
    """SQL text of the same ladder, for oracle queries."""
    parts = " ".join(f"WHEN {x} < {t!r} THEN '{label}'" for t, label in steps)
    return f"CASE {parts} ELSE '{otherwise}' END"


def sql_iv_strength(x: str) -> str:
    parts = " ".join(f"WHEN {x} >= {lo!r} AND {x} < {hi!r} THEN '{label}'" for lo, hi, label in IV_LADDER)
    return f"CASE {parts} ELSE 'Unknown' END"


def sql_effect_size(x: str) -> str:
    return sql_case_upper(f"abs({x})", [(0.1, "Negligible"), (0.3, "Small"), (0.5, "Medium")], "Large")


def sql_ks_grade(x: str) -> str:
    return sql_case_upper(x, [(0.20, "Poor"), (0.40, "Average"), (0.60, "Good")], "Excellent")


def sql_score_band(x: str) -> str:
    parts = " ".join(f"WHEN {x} >= {f} THEN '{b}'" for f, b, _ in SCORE_BANDS[:-1])
    return f"CASE {parts} ELSE '{SCORE_BANDS[-1][1]}' END"


def sql_score_decision(x: str) -> str:
    parts = " ".join(f"WHEN {x} >= {f} THEN '{d}'" for f, _, d in SCORE_BANDS[:-1])
    return f"CASE {parts} ELSE '{SCORE_BANDS[-1][2]}' END"


def sql_band_rank(x: str) -> str:
    parts = " ".join(f"WHEN {x} = '{b}' THEN {i}" for i, b in enumerate(BAND_ORDER))
    return f"CASE {parts} END"
