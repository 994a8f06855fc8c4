"""Model evaluation (G1-G16) from one intermediate.

``score_counts``: one row per (model..., distinct score) with the numbers
of positives and negatives; descending prefix sums over it give, at every
threshold ``score >= s``, the true and false positives.  ROC, AUC, KS,
average precision and the curves are sums over that table, so they are
exact with ties, need no row-level sort, and evaluate any number of models
(the ``group_cols`` key) in the same job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import ks_grade
from ..functions.numeric import clip, np_round
from ..functions.pvalues import chi2_sf
from .binning import qcut_probs
from .ordered import CacheScope, _persist, prefix_sums
from .quantiles import select

EPS = 2.220446049250313e-16  # float64 machine epsilon (log-loss clipping)


def score_counts(df: DataFrame, score: str, label: str, group_cols: list[str] | None = None) -> DataFrame:
    g = group_cols or []
    y = F.col(label)
    return df.where(F.col(score).isNotNull() & y.isin(0, 1)).groupBy(*g, F.col(score).alias("score")).agg(
        F.sum((y == 1).cast("bigint")).alias("pos"), F.sum((y == 0).cast("bigint")).alias("neg"))


def roc_table(df: DataFrame, score: str, label: str, group_cols: list[str] | None = None,
              local_limit: int | None = None) -> DataFrame:
    """G1: (group..., threshold, pos, neg, tp, fp, P, N, fpr, tpr) per
    distinct score, thresholds descending (``score >= threshold``)."""
    g = group_cols or []
    sc = score_counts(df, score, label, g)
    pre = prefix_sums(sc, g, "score", ["pos", "neg"], ascending=False, local_limit=local_limit)
    return pre.select(
        *g, F.col("score").alias("threshold"), "pos", "neg",
        F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
        F.col("tot_pos").alias("P"), F.col("tot_neg").alias("N"),
        (F.col("cum_neg") / F.col("tot_neg")).alias("fpr"),
        (F.col("cum_pos") / F.col("tot_pos")).alias("tpr"))


def roc_corners(roc: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """G1 as the curve is drawn: of ``roc_table`` the first and last point of
    each group and those where the step to the next point differs from the
    step before, so that points on a straight run of equal steps go.

    The next point is the row whose rows before it are all up to this one: an
    equi-join on that number, which needs no order inside a task."""
    g = group_cols or []
    upto, before = F.col("tp") + F.col("fp"), F.col("tp") + F.col("fp") - F.col("pos") - F.col("neg")
    roc = _persist(roc)
    after = roc.select(*[F.col(c).alias(f"_{c}") for c in g], before.alias("_before"), F.col("pos").alias("_pos"), F.col("neg").alias("_neg"))
    same = upto == F.col("_before")
    for c in g:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    keep = (before == 0) | F.col("_before").isNull() | (F.col("pos") != F.col("_pos")) | (F.col("neg") != F.col("_neg"))
    return roc.join(after, same, "left").where(keep).select(*[F.col(c) for c in roc.columns])


def ranking_metrics(roc: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """G2-G6 (unrounded): auc, ks, ap per group."""
    g = group_cols or []
    P, N = F.col("P").cast("double"), F.col("N").cast("double")
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    return roc.groupBy(*g).agg(
        # whole numbers, exact and without overflow at any class size
        (F.sum(whole("neg") * (whole("tp") * 2 - whole("pos"))).cast("double") / (F.first(P) * F.first(N) * 2)).alias("auc"),
        F.greatest(F.max(F.col("tpr") - F.col("fpr")), F.lit(0.0)).alias("ks"),
        F.sum(F.col("pos") / P * (F.col("tp") / (F.col("tp") + F.col("fp")))).alias("ap"),
        F.first("P").alias("P"), F.first("N").alias("N"))


def pointwise_metrics(df: DataFrame, score: str, label: str, threshold: float = 0.5,
                      group_cols: list[str] | None = None) -> DataFrame:
    """G7-G9 (unrounded): brier, log loss, confusion counts at ``p >= t``."""
    g = group_cols or []
    p, y = F.col(score).cast("double"), F.col(label)
    pc = clip(p, EPS, 1 - EPS)
    pred = p >= threshold
    return df.where(p.isNotNull() & y.isin(0, 1)).groupBy(*g).agg(
        F.avg((p - y) * (p - y)).alias("brier"),
        F.avg(-(y * F.ln(pc) + (1 - y) * F.ln(1 - pc))).alias("log_loss"),
        F.sum((pred & (y == 1)).cast("bigint")).alias("TP"),
        F.sum((~pred & (y == 0)).cast("bigint")).alias("TN"),
        F.sum((pred & (y == 0)).cast("bigint")).alias("FP"),
        F.sum((~pred & (y == 1)).cast("bigint")).alias("FN"))


def _safe_div(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def pointwise_from_roc(roc: DataFrame, threshold: float = 0.5, group_cols: list[str] | None = None) -> DataFrame:
    """G7-G9 from the distinct-score table instead of the rows: Brier, log
    loss and the confusion counts at ``p >= t`` are sums over distinct
    scores weighted by their positive / negative counts."""
    g = group_cols or []
    s = F.col("threshold").cast("double")
    sc = clip(s, EPS, 1 - EPS)
    pos, neg = F.col("pos"), F.col("neg")
    hit = s >= threshold
    n = F.sum(pos + neg)
    return roc.groupBy(*g).agg(
        (F.sum(pos * (s - 1) * (s - 1) + neg * s * s) / n).alias("brier"),
        (F.sum(pos * -F.ln(sc) + neg * -F.ln(1 - sc)) / n).alias("log_loss"),
        F.sum(F.when(hit, pos).otherwise(0)).alias("TP"),
        F.sum(F.when(~hit, neg).otherwise(0)).alias("TN"),
        F.sum(F.when(hit, neg).otherwise(0)).alias("FP"),
        F.sum(F.when(~hit, pos).otherwise(0)).alias("FN"))


def all_metrics(df: DataFrame, score: str, label: str, threshold: float = 0.5,
                group_cols: list[str] | None = None, local_limit: int | None = None) -> DataFrame:
    """The full metric row per model, rounded to 4 dp.  The rows are
    read once: every metric is a sum over the distinct-score table."""
    g = group_cols or []
    roc = roc_table(df, score, label, g, local_limit)
    rk = ranking_metrics(roc, g)
    pt = pointwise_from_roc(roc, threshold, g)
    if g:
        j = rk.join(pt, g, "inner")
    else:  # one row each side
        j = rk.withColumn("_k", F.lit(1)).join(pt.withColumn("_k", F.lit(1)), "_k")
    tp, fp, fn = F.col("TP"), F.col("FP"), F.col("FN")
    precision = _safe_div(tp, tp + fp)
    recall = _safe_div(tp, tp + fn)
    f1 = _safe_div(tp * 2.0, tp * 2 + fp + fn)
    gini = np_round(F.col("auc") * 2 - 1, 4)
    return j.select(
        *g, np_round("auc", 4).alias("roc_auc"), np_round("ks", 4).alias("ks_statistic"),
        np_round(gini, 4).alias("gini"), np_round("ap", 4).alias("pr_auc"), np_round("brier", 4).alias("brier_score"),
        np_round("log_loss", 4).alias("log_loss"), np_round(f1, 4).alias("f1_score"),
        F.lit(float(threshold)).alias("threshold"), F.col("TP").cast("bigint").alias("TP"),
        F.col("TN").cast("bigint").alias("TN"), F.col("FP").cast("bigint").alias("FP"),
        F.col("FN").cast("bigint").alias("FN"),
        np_round(precision, 4).alias("precision"), np_round(recall, 4).alias("recall"))


def model_comparison(metrics: DataFrame, model_col: str = "model") -> DataFrame:
    """7 columns, best AUC first."""
    return metrics.select(model_col, "roc_auc", "ks_statistic", "gini", "pr_auc", "brier_score", "f1_score") \
        .orderBy(F.desc("roc_auc"), model_col)


def best_per_metric(metrics: DataFrame, model_col: str = "model") -> DataFrame:
    """(metric, best_model, value): max for all but Brier (min)."""
    cols = ["roc_auc", "ks_statistic", "gini", "pr_auc", "f1_score"]
    aggs = [F.max_by(model_col, F.struct(c, F.col(model_col))).alias(f"b_{c}") for c in cols] + \
           [F.max(c).alias(f"v_{c}") for c in cols] + \
           [F.min_by(model_col, F.struct("brier_score", F.col(model_col))).alias("b_brier_score"),
            F.min("brier_score").alias("v_brier_score")]
    wide = metrics.agg(*aggs)
    allc = cols + ["brier_score"]
    stack = ", ".join(f"'{c}', b_{c}, CAST(v_{c} AS DOUBLE)" for c in allc)
    return wide.selectExpr(f"stack({len(allc)}, {stack}) as (metric, best_model, value)")


def normalized_metrics(metrics: DataFrame, model_col: str = "model",
                       cols: tuple = ("roc_auc", "ks_statistic", "gini", "pr_auc", "f1_score")) -> DataFrame:
    """(model, metric, value, normalized) with (x-min)/(max-min+1e-9)
    across models."""
    stack = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in cols)
    long = metrics.selectExpr(model_col, f"stack({len(cols)}, {stack}) as (metric, value)")
    w = Window.partitionBy("metric")
    return long.select(model_col, "metric", "value",
                       ((F.col("value") - F.min("value").over(w))
                        / (F.max("value").over(w) - F.min("value").over(w) + 1e-9)).alias("normalized"))


def classification_report(df: DataFrame, score: str, label: str, threshold: float = 0.5,
                          group_cols: list[str] | None = None) -> DataFrame:
    """Per class (0, 1) and macro / weighted averages:
    (class, precision, recall, f1, support)."""
    g = group_cols or []
    c = pointwise_metrics(df, score, label, threshold, g)
    tp, tn, fp, fn = (F.col(x).cast("double") for x in ("TP", "TN", "FP", "FN"))
    p1, r1 = _safe_div(tp, tp + fp), _safe_div(tp, tp + fn)
    p0, r0 = _safe_div(tn, tn + fn), _safe_div(tn, tn + fp)
    f = lambda p, r: _safe_div(p * r * 2, p + r)
    s0, s1 = tn + fp, tp + fn
    rows = c.select(*g,
                    p0.alias("p0"), r0.alias("r0"), f(p0, r0).alias("f0"), s0.alias("s0"),
                    p1.alias("p1"), r1.alias("r1"), f(p1, r1).alias("f1"), s1.alias("s1"))
    n = F.col("s0") + F.col("s1")
    def row(name, p_, r_, f_, s_):
        return F.struct(F.lit(name).alias("class"), p_.alias("precision"), r_.alias("recall"), f_.alias("f1"),
                        s_.alias("support"))

    p0c, r0c, f0c, s0c = F.col("p0"), F.col("r0"), F.col("f0"), F.col("s0")
    p1c, r1c, f1c, s1c = F.col("p1"), F.col("r1"), F.col("f1"), F.col("s1")
    out = rows.select(*g, F.array(
        row("0", p0c, r0c, f0c, s0c),
        row("1", p1c, r1c, f1c, s1c),
        row("macro avg", (p0c + p1c) / 2, (r0c + r1c) / 2, (f0c + f1c) / 2, n),
        row("weighted avg", (p0c * s0c + p1c * s1c) / n, (r0c * s0c + r1c * s1c) / n,
            (f0c * s0c + f1c * s1c) / n, n)).alias("rows"))
    ex = out.select(*g, F.explode("rows").alias("r")).select(*g, "r.*")
    return ex.select(*g, "class", *[np_round(c_, 4).alias(c_) for c_ in ("precision", "recall", "f1")],
                     F.col("support").cast("bigint").alias("support"))


def calibration_curve(df: DataFrame, score: str, label: str, n_bins: int = 10,
                      group_cols: list[str] | None = None) -> DataFrame:
    """Uniform right-closed bins on the literal edges i/n (i * step as
    in linspace); non-empty bins only: (bin, mean_pred, frac_pos, n)."""
    g = group_cols or []
    step = 1.0 / n_bins
    edges = [i * step for i in range(1, n_bins)]
    p = F.col(score).cast("double")
    b = None
    for i, e in enumerate(edges):
        b = F.when(p <= e, i) if b is None else b.when(p <= e, i)
    b = b.otherwise(n_bins - 1) if b is not None else F.lit(0)
    return df.where(p.isNotNull()).groupBy(*g, b.alias("bin")).agg(
        F.avg(p).alias("mean_pred"), F.avg(F.col(label).cast("double")).alias("frac_pos"),
        F.count(F.lit(1)).alias("n"))


def _decile_bins(df, score, group_cols, n_bins, local_limit):
    """Quantile edges of the score per group -> bin id expression."""
    g = group_cols or []
    with CacheScope():
        found = select(df, [score], qcut_probs(n_bins), g, local_limit=local_limit).values   # groups x (n_bins + 1)
    per = {group: {float(v) for v in q} for (group, _), q in found.items()}
    p = F.col(score).cast("double")
    expr = None
    lo_hi = []
    for key, es in per.items():
        e = sorted(es)
        inner = F.when(p.isNull() | (p < e[0]), F.lit(None))
        for i in range(1, len(e)):
            inner = inner.when(p <= e[i], i)
            lo_hi.append((*key, i, e[i - 1], e[i]))
        inner = inner.otherwise(F.lit(None))
        cond = F.lit(True)
        for c, v in zip(g, key):
            cond = cond & (F.col(c) == v)
        expr = F.when(cond, inner) if expr is None else expr.when(cond, inner)
    return expr, lo_hi


def hosmer_lemeshow_table(df: DataFrame, score: str, label: str, n_bins: int = 10,
                          group_cols: list[str] | None = None, local_limit: int | None = None) -> DataFrame:
    """G15 table: qcut deciles of the score (duplicate edges merged):
    (decile, lo, hi, n, obs_1, exp_1, obs_0, exp_0)."""
    g = group_cols or []
    expr, _ = _decile_bins(df, score, g, n_bins, local_limit)
    y = F.col(label)
    t = df.where(F.col(score).isNotNull()).groupBy(*g, expr.alias("decile")).agg(
        F.count(y).alias("n"), F.sum(y).alias("obs_1"), F.sum(F.col(score)).alias("exp_1"),
        F.min(score).alias("p_min"), F.max(score).alias("p_max")).where(F.col("decile").isNotNull())
    return t.select(*g, "decile", "n", "obs_1", "exp_1", (F.col("n") - F.col("obs_1")).alias("obs_0"),
                    (F.col("n") - F.col("exp_1")).alias("exp_0"))


def hosmer_lemeshow(df: DataFrame, score: str, label: str, n_bins: int = 10,
                    group_cols: list[str] | None = None, local_limit: int | None = None) -> DataFrame:
    """(hl_statistic, p_value, dof, n_groups, result); dof = n_bins - 2
    whatever the number of groups left after merging."""
    g = group_cols or []
    t = hosmer_lemeshow_table(df, score, label, n_bins, g, local_limit)
    term = ((F.col("obs_1") - F.col("exp_1")) ** 2 / F.greatest(F.col("exp_1"), F.lit(0.001))
            + (F.col("obs_0") - F.col("exp_0")) ** 2 / F.greatest(F.col("exp_0"), F.lit(0.001)))
    s = t.groupBy(*g).agg(F.sum(term).alias("_hl"), F.count(F.lit(1)).alias("n_groups"))
    dof = n_bins - 2
    s = s.select(*g, "_hl", "n_groups", chi2_sf(F.col("_hl"), F.lit(dof)).alias("_p"))
    return s.select(*g, np_round("_hl", 4).alias("hl_statistic"), np_round("_p", 4).alias("p_value"),
                    F.lit(dof).cast("bigint").alias("dof"), F.col("n_groups").cast("bigint").alias("n_groups"),
                    F.when(F.col("_p") > 0.05, "Well calibrated").otherwise("Poorly calibrated").alias("result"))


def ks_curve(df: DataFrame, score: str, label: str, key: str, local_limit: int | None = None) -> DataFrame:
    """Rows ranked by (score desc, key): (key, score, pct_population,
    cdf_bad, cdf_good, gap) with cumulative shares in percent."""
    y = F.col(label)
    rows = df.where(F.col(score).isNotNull() & y.isin(0, 1)).select(
        F.col(key), F.col(score).alias("score"),
        F.struct((-F.col(score)).alias("s"), F.col(key).alias("k")).alias("_ord"),
        (y == 1).cast("bigint").alias("bad"), (y == 0).cast("bigint").alias("good"),
        F.lit(1).cast("bigint").alias("one"))
    pre = prefix_sums(rows, [], "_ord", ["bad", "good", "one"], local_limit=local_limit)
    cb = F.col("cum_bad") / F.col("tot_bad") * 100
    cg = F.col("cum_good") / F.col("tot_good") * 100
    return pre.select(key, "score", (F.col("cum_one") / F.col("tot_one") * 100).alias("pct_population"),
                      cb.alias("cdf_bad"), cg.alias("cdf_good"), F.abs(cb - cg).alias("gap"))


def auc_ks_gini(df: DataFrame, score: str, label: str, group_cols: list[str] | None = None,
                local_limit: int | None = None) -> DataFrame:
    """G2-G4 compact: (auc, ks, gini, ks_grade)."""
    g = group_cols or []
    r = ranking_metrics(roc_table(df, score, label, g, local_limit), g)
    return r.select(*g, np_round("auc", 4).alias("roc_auc"), np_round("ks", 4).alias("ks_statistic"),
                    np_round(F.col("auc") * 2 - 1, 4).alias("gini"), ks_grade(F.col("ks")).alias("ks_grade"))
