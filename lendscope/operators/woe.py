"""Weight of Evidence / Information Value.

All features are binned in one projection, unpivoted to
(feature, bin_key, target) and counted by a single hash aggregate keyed on
(feature, bin_key): the map side combines, so the shuffle carries one row
per (partition, feature, bin) no matter how many rows or how skewed a bin.

Semantics kept from the reference workflow:
* smoothing adds ``epsilon`` to numerator and denominator of both shares;
* totals count every row: ``total_non_events = rows - sum(target)`` (null
  targets and null-feature rows count), while null bins vanish;
* WoE is rounded to 4 dp before it becomes the encoding, IV per feature is
  the unrounded sum, rounded at the end;
* a feature whose target has a single class is skipped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import np_round

from ..functions.labels import iv_strength
from .binning import BinEdges, edges_of, fit_quantile_edges, qcut_probs
from .ordered import CacheScope
from .quantiles import select

MAP_LITERAL_LIMIT = 5_000


@dataclass
class WoeModel:
    """Fitted WoE state: edges per numeric feature and the long WoE table."""

    edges: BinEdges
    table: DataFrame            # see woe_table() for columns
    numeric_cols: list[str]
    categorical_cols: list[str]
    _lookup: dict | None = None
    _levels: dict | None = None

    def levels(self) -> dict[str, int]:
        """Rows of the fitted table per feature (features rows collected)."""
        if self._levels is None:
            self._levels = {r["feature"]: r["n"] for r in
                            self.table.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
        return self._levels

    # -- small driver-side view of the fitted table: numeric bins and the
    # categorical features of at most MAP_LITERAL_LIMIT levels; wider ones
    # are joined and never collected
    def lookup(self) -> dict[str, dict]:
        if self._lookup is None:
            look: dict[str, dict] = {}
            small = [f for f in self.levels() if not self.needs_join(f)]
            for r in self.table.where(F.col("feature").isin(small)).select("feature", "bin_id", "category", "woe").collect():
                key = r["bin_id"] if r["feature"] in self.numeric_cols else r["category"]
                look.setdefault(r["feature"], {})[key] = float(r["woe"])
            self._lookup = look
        return self._lookup

    def class_totals(self) -> tuple[int, int]:
        """(events, rows with a target) of the fitting table, known from the
        fit (no pass over the rows)."""
        r = self.table.select("_te", "_tnn").first()
        return int(r["_te"]), int(r["_tnn"])

    def needs_join(self, feature: str) -> bool:
        return feature in self.categorical_cols and self.levels().get(feature, 0) > MAP_LITERAL_LIMIT

    @property
    def features(self) -> list[str]:
        return [f for f in self.numeric_cols + self.categorical_cols if f in self.levels()]

    def woe_column(self, feature: str, new_data: bool = False) -> Column:
        """WoE of one feature as a column expression.

        ``new_data=False``: unmatched values give null (training encode).
        ``new_data=True``: numeric values are clamped to the first/last bin
        (null and NaN go to the last bin) and unseen or null categories get
        0.0 (new applicants).
        """
        look = self.lookup().get(feature, {})
        x = F.col(feature)
        if feature in self.numeric_cols:
            b = self.edges.bin_id(feature, x, clamp=new_data)
            expr = None
            for bin_id in sorted(look):
                cond = b == bin_id
                expr = F.when(cond, look[bin_id]) if expr is None else expr.when(cond, look[bin_id])
            if expr is None:
                return F.lit(0.0 if new_data else None).cast("double")
            return expr.otherwise(F.lit(0.0 if new_data else None)).cast("double")
        if self.needs_join(feature):
            raise ValueError("too many levels for a literal map; encode() joins instead")
        m = F.create_map(*[v for k, w in look.items() for v in (F.lit(k), F.lit(w))])
        val = F.try_element_at(m, x.cast("string"))
        return F.coalesce(val, F.lit(0.0)) if new_data else val.cast("double")


def woe_table_from_counts(counts: DataFrame, numeric_cols: list[str], edges: BinEdges,
                          epsilon: float = 0.5) -> DataFrame:
    """From (feature, bin_key, events, total, rows) incl. the null bin, build
    the WoE table.  ``counts`` is tiny (features x bins)."""
    spark = counts.sparkSession
    w = Window.partitionBy("feature")
    t = counts.select(
        "*",
        F.sum("events").over(w).alias("_te"),
        F.sum("rows").over(w).alias("_n"),
        F.sum("total").over(w).alias("_tnn"),
    ).where(F.col("bin_key").isNotNull())
    te = F.col("_te").cast("double")
    tne = (F.col("_n") - F.col("_te")).cast("double")
    t = t.where((F.col("_te") > 0) & (F.col("_n") - F.col("_te") > 0))
    non_events = F.col("total") - F.col("events")
    pct_e = (F.col("events") + epsilon) / (te + epsilon)
    pct_ne = (non_events + epsilon) / (tne + epsilon)
    is_num = F.col("feature").isin(numeric_cols) if numeric_cols else F.lit(False)
    t = t.select(
        "feature",
        F.when(is_num, F.col("bin_key").cast("int")).alias("bin_id"),
        F.when(~is_num, F.col("bin_key")).alias("category"),
        F.col("total").cast("bigint").alias("total"),
        F.col("events").cast("bigint").alias("events"),
        non_events.cast("bigint").alias("non_events"),
        F.when(F.col("total") > 0, F.col("events") / F.col("total")).alias("default_rate"),
        pct_e.alias("pct_events"),
        pct_ne.alias("pct_non_events"),
        F.ln(pct_e / pct_ne).alias("woe_raw"),
        "_te", "_tnn",
    ).withColumn("iv_raw", (F.col("pct_events") - F.col("pct_non_events")) * F.col("woe_raw"))
    edge_df = F.broadcast(edges.to_df(spark))  # features x bins rows
    t = t.join(edge_df, ["feature", "bin_id"], "left")
    return t.select(
        "feature", "bin_id", "lo", "hi", "category", "total", "events", "non_events",
        np_round("default_rate", 4).alias("default_rate"),
        np_round("pct_events", 4).alias("pct_events"),
        np_round("pct_non_events", 4).alias("pct_non_events"),
        np_round("woe_raw", 4).alias("woe"),
        np_round("iv_raw", 4).alias("iv"),
        "iv_raw", "_te", "_tnn",
    )


def bin_counts(df: DataFrame, target: str, numeric_cols: list[str], categorical_cols: list[str],
               edges: BinEdges) -> DataFrame:
    """One pass: (feature, bin_key, events, total, rows), null bin included."""
    features = numeric_cols + categorical_cols
    projected = df.select(
        F.col(target).alias("_y"),
        *[edges.bin_id(f, F.col(f)).cast("string").alias(f) for f in numeric_cols],
        *[F.col(c).cast("string").alias(c) for c in categorical_cols],
    )
    long = projected.unpivot(["_y"], features, "feature", "bin_key")
    return long.groupBy("feature", "bin_key").agg(
        F.sum("_y").alias("events"),
        F.count("_y").alias("total"),
        F.count(F.lit(1)).alias("rows"),
    )


def fit_woe(df: DataFrame, target: str, numeric_cols: list[str], categorical_cols: list[str],
            bins: int = 10, epsilon: float = 0.5, edges: BinEdges | None = None,
            local_limit: int | None = None, edge_method: str = "exact") -> WoeModel:
    """WoE tables of all features.

    Two narrow scans: a sketch, then the slot counts of the bracketed
    selection (with the categorical levels beside), which give the exact
    quantile edges and, re-aggregated, the bin counts.  With given edges or
    ``edge_method="approx"`` the edges are fitted first and the rows are
    binned directly."""
    if edges is not None or edge_method != "exact" or not numeric_cols:
        edges = edges or fit_quantile_edges(df, numeric_cols, bins, local_limit=local_limit, method=edge_method)
        counts = bin_counts(df, target, numeric_cols, categorical_cols, edges)
        table = woe_table_from_counts(counts, numeric_cols, edges, epsilon).persist()
        return WoeModel(edges, table, list(numeric_cols), list(categorical_cols))
    with CacheScope():
        sel = select(df, numeric_cols, qcut_probs(bins), sums={"total": F.col(target).isNotNull().cast("int"), "events": F.col(target)},
                     levels=categorical_cols, local_limit=local_limit)
        edges, dist = edges_of(sel, numeric_cols), sel.slots
        bin_of = None
        for f in numeric_cols:
            b = edges.bin_id(f, F.col("rep")).cast("string")
            bin_of = F.when(F.col("feature") == f, b) if bin_of is None else bin_of.when(F.col("feature") == f, b)
        key = bin_of.otherwise(F.col("level"))
        counts = dist.groupBy("feature", key.alias("bin_key")).agg(
            F.sum("events").alias("events"), F.sum("total").alias("total"), F.sum("rows").alias("rows"))
        table = woe_table_from_counts(counts, numeric_cols, edges, epsilon).persist()
        model = WoeModel(edges, table, list(numeric_cols), list(categorical_cols))
        model.lookup()   # materializes the small table before the distinct counts are released
    return model


def woe_table(model: WoeModel) -> DataFrame:
    return model.table.drop("iv_raw", "_te", "_tnn")


def iv_summary(model: WoeModel) -> DataFrame:
    """(feature, iv, strength), strongest first."""
    s = model.table.groupBy("feature").agg(np_round(F.sum("iv_raw"), 4).alias("iv"))
    return s.select("feature", "iv", iv_strength(F.col("iv")).alias("strength")).orderBy(
        F.desc("iv"), "feature")


def select_by_iv(summary: DataFrame, threshold: float = 0.02) -> DataFrame:
    """(feature, iv, selected) with selected = iv >= threshold."""
    return summary.select("feature", "iv", (F.col("iv") >= threshold).alias("selected"))


def selected_features(summary: DataFrame, threshold: float = 0.02) -> list[str]:
    """Names of selected features (one row per feature: bounded)."""
    return [r["feature"] for r in summary.where(F.col("iv") >= threshold).select("feature").collect()]


def top_k_by_iv(summary: DataFrame, k: int = 6) -> DataFrame:
    """D11."""
    return summary.orderBy(F.desc("iv"), "feature").limit(k)


def encode(df: DataFrame, model: WoeModel, features: list[str] | None = None, suffix: str = "_woe",
           keep: list[str] | None = None, new_data: bool = False) -> DataFrame:
    """D8 (``new_data=False``) / D9 (``new_data=True``): add ``<f>_woe``
    columns.  Numeric features and categoricals with up to
    ``MAP_LITERAL_LIMIT`` levels are generated expressions (one narrow
    projection); a categorical with more levels is looked up with an
    equi-join on the level against its WoE rows, which the optimizer
    broadcasts only under its size threshold and shuffles otherwise."""
    features = features or model.features
    keep = keep if keep is not None else df.columns
    joined = [f for f in features if model.needs_join(f)]
    base = df
    for f in joined:
        t = model.table.where(F.col("feature") == f).select(
            F.col("category").alias(f"_lvl_{f}"), F.col("woe").alias(f"_w_{f}"))
        base = base.join(t, F.col(f).cast("string") == F.col(f"_lvl_{f}"), "left")
    cols = []
    for f in features:
        if f in joined:
            w = F.col(f"_w_{f}")
            cols.append((F.coalesce(w, F.lit(0.0)) if new_data else w).alias(f + suffix))
        else:
            cols.append(model.woe_column(f, new_data).alias(f + suffix))
    return base.select(*[F.col(c) for c in keep], *cols)
