"""Points scorecard.

A model is a small coefficient table: (feature, beta) plus an intercept.
Scoring is a generated column expression (WoE lookup -> linear predictor
-> score, PD, band, decision): one narrow, fully code-generated stage with
no join and no Python, identical for batch and streaming input.

Fixed values: base score 600, PDO 20, base odds 1 (1:1); score bands in
``functions.labels``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import band_rank, score_band, score_decision
from ..functions.numeric import np_round
from .woe import WoeModel
from .woe import encode as woe_encode

BASE_SCORE, PDO, BASE_ODDS = 600, 20, 1


def scaling(pdo: float = PDO, base_score: float = BASE_SCORE, base_odds: float = BASE_ODDS) -> tuple[float, float]:
    """H1: factor = pdo / ln 2, offset = base - factor ln(odds + 1e-9)."""
    factor = pdo / math.log(2)
    return factor, base_score - factor * math.log(base_odds + 1e-9)


@dataclass
class ScoreModel:
    intercept: float
    betas: dict[str, float]     # raw feature -> beta of its WoE column
    woe: WoeModel
    factor: float
    offset: float

    @property
    def features(self) -> list[str]:
        return list(self.betas)

    def per_feature_intercept(self) -> float:
        return self.intercept / len(self.betas)

    def points(self, woe_col: Column, feature: str) -> Column:
        return -(F.lit(self.betas[feature]) * woe_col + F.lit(self.per_feature_intercept())) * self.factor

    def log_odds(self, suffix: str = "_woe") -> Column:
        expr = F.lit(self.intercept)
        for f, b in self.betas.items():
            expr = expr + F.lit(b) * F.col(f + suffix)
        return expr


def build_model(intercept: float, betas: dict[str, float], woe: WoeModel, pdo=PDO, base_score=BASE_SCORE,
                base_odds=BASE_ODDS) -> ScoreModel:
    factor, offset = scaling(pdo, base_score, base_odds)
    return ScoreModel(float(intercept), {k: float(v) for k, v in betas.items()}, woe, factor, offset)


def build_scorecard(model: ScoreModel) -> DataFrame:
    """H2: one row per (feature, bin): count, default rate, WoE, beta, points
    (1 dp).  The WoE table (features x bins) is joined with the coefficient
    table (features rows) -- both tiny."""
    spark = model.woe.table.sparkSession
    coef = spark.createDataFrame(list(model.betas.items()), "feature string, beta double")
    t = model.woe.table.join(F.broadcast(coef), "feature")
    pts = -(F.col("beta") * F.col("woe") + F.lit(model.per_feature_intercept())) * model.factor
    return t.select("feature", "bin_id", "lo", "hi", "category", F.col("total").alias("count"), "default_rate", "woe",
                    np_round("beta", 4).alias("beta"), np_round(pts, 1).alias("points"))


def score(df: DataFrame, model: ScoreModel, keep: list[str] | None = None, new_data: bool = False,
          suffix: str = "_woe") -> DataFrame:
    """H3: add credit_score, default_prob, score_band, decision.  Rows with a
    null WoE are dropped (batch); ``new_data`` clamps instead (applicants)."""
    keep = keep if keep is not None else df.columns
    enc = woe_encode(df, model.woe, model.features, suffix=suffix, keep=keep, new_data=new_data)
    enc = enc.na.drop(subset=[f + suffix for f in model.features])
    lo = model.log_odds(suffix)
    s = F.bround(F.lit(model.offset) - F.lit(model.factor) * lo, 0).cast("int")
    out = enc.select("*", s.alias("credit_score"),
                     np_round(F.lit(1.0) / (F.lit(1.0) + F.exp(-lo)), 4).alias("default_prob"))
    return out.select("*", score_band(F.col("credit_score")).alias("score_band"),
                      score_decision(F.col("credit_score")).alias("decision"))


def breakdown(df: DataFrame, model: ScoreModel, key: str, new_data: bool = True) -> DataFrame:
    """H4: (key, feature, value, woe, points) per applicant and feature --
    an array of structs exploded, no shuffle."""
    enc = woe_encode(df, model.woe, model.features, suffix="__w", keep=[key, *model.features], new_data=new_data)
    parts = []
    for f in model.features:
        w = F.col(f + "__w")
        parts.append(F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value"),
                              np_round(w, 4).alias("woe"), np_round(model.points(w, f), 1).alias("points")))
    return enc.select(F.col(key), F.explode(F.array(*parts)).alias("b")).select(key, "b.*")


def reason_codes(df: DataFrame, model: ScoreModel, key: str, n: int = 3, new_data: bool = True) -> DataFrame:
    """H5: the n features with the lowest points per applicant, ties in
    feature order: sort a per-row array (no shuffle), keep the first n."""
    enc = woe_encode(df, model.woe, model.features, suffix="__w", keep=[key], new_data=new_data)
    parts = []
    for i, f in enumerate(model.features):
        w = F.col(f + "__w")
        parts.append(F.struct(np_round(model.points(w, f), 1).alias("points"), F.lit(i).alias("pos"),
                              F.lit(f).alias("feature")))
    arr = F.slice(F.array_sort(F.array(*parts)), 1, n)
    return enc.select(F.col(key), F.posexplode(arr).alias("rank0", "r")).select(
        key, (F.col("rank0") + 1).alias("rank"), "r.feature", "r.points")


def explained(df: DataFrame, model: ScoreModel, key: str, n: int = 3, new_data: bool = True) -> DataFrame:
    """H4 and H5 together: (key, feature, value, woe, points, reason) with
    ``reason`` 1..n for the n features of lowest points (ties in feature
    order); one sorted array a row, no shuffle."""
    enc = woe_encode(df, model.woe, model.features, suffix="__w", keep=[key, *model.features], new_data=new_data)
    parts = []
    for i, f in enumerate(model.features):
        w = F.col(f + "__w")
        parts.append(F.struct(np_round(model.points(w, f), 1).alias("points"), F.lit(i).alias("pos"), F.lit(f).alias("feature"),
                              F.col(f).cast("string").alias("value"), np_round(w, 4).alias("woe")))
    return (enc.select(F.col(key), F.posexplode(F.array_sort(F.array(*parts))).alias("at", "r"))
            .select(key, "r.feature", "r.value", "r.woe", "r.points", F.when(F.col("at") < n, F.col("at") + 1).alias("reason")))


def band_performance(scored: DataFrame, target: str = "target") -> DataFrame:
    """H7: per band: count, defaults, default rate and mean score (3 dp),
    approval rate = 1 - rounded rate; bands worst first."""
    y = F.col(target)
    g = scored.groupBy("score_band").agg(
        F.count(y).alias("count"), F.sum(y).alias("defaults"), F.avg(y.cast("double")).alias("_r"),
        F.avg("credit_score").alias("_s"))
    rate = np_round("_r", 3)
    return g.select("score_band", "count", F.col("defaults").cast("bigint").alias("defaults"),
                    rate.alias("default_rate"), np_round("_s", 3).alias("avg_score"),
                    np_round(F.lit(1.0) - rate, 3).alias("approval_rate"),
                    band_rank(F.col("score_band")).alias("band_order")).orderBy("band_order")


def points_range(card: DataFrame, top_n: int | None = None) -> DataFrame:
    """H8: max - min points per feature, widest first."""
    r = card.groupBy("feature").agg((F.max("points") - F.min("points")).alias("points_range")).select(
        "feature", np_round("points_range", 1).alias("points_range")).orderBy(F.desc("points_range"), "feature")
    return r.limit(top_n) if top_n else r


def score_summary(scored: DataFrame, target: str = "target") -> DataFrame:
    """Per class and overall: n, min, max, mean score."""
    s = F.col("credit_score")
    by = scored.groupBy(F.col(target).cast("string").alias("group")).agg(
        F.count(s).alias("n"), F.min(s).alias("min_score"), F.max(s).alias("max_score"), F.avg(s).alias("mean_score"))
    allr = scored.agg(F.lit("all").alias("group"), F.count(s).alias("n"), F.min(s).alias("min_score"),
                      F.max(s).alias("max_score"), F.avg(s).alias("mean_score"))
    return by.unionByName(allr).select("group", "n", "min_score", "max_score", np_round("mean_score", 2).alias("mean_score"))
