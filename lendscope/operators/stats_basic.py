"""Profiling aggregations (C1-C10) and correlation helpers.

Every operator handles all requested columns in one pass (or two when a
second pass needs fitted bounds), unpivoting to a long (feature, value)
layout so that the number of columns never turns into a Python loop of
jobs.  Quantiles are exact (see ``quantiles.select``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import np_round

from .ordered import CacheScope, _persist, unpivot_numeric
from .quantiles import select


def basic_info(df: DataFrame, target: str) -> DataFrame:
    """One row (n_rows, n_cols, total_nulls, default_rate, n_good, n_default)."""
    nulls = [F.sum(F.col(c).isNull().cast("bigint")) for c in df.columns]
    total_nulls = nulls[0]
    for e in nulls[1:]:
        total_nulls = total_nulls + e
    y = F.col(target)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("n_cols"),
        total_nulls.cast("bigint").alias("total_nulls"),
        F.avg(y.cast("double")).alias("default_rate"),
        F.sum((y == 0).cast("bigint")).alias("n_good"),
        F.sum((y == 1).cast("bigint")).alias("n_default"),
    )


def value_share(df: DataFrame, col: str) -> DataFrame:
    """(value, n, share_pct) with share in percent of all rows."""
    total = df.count()
    return df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(
        "value", "n", (F.col("n") * 100.0 / F.lit(total)).alias("share_pct"))


def default_rate_by_category(df: DataFrame, target: str, categorical_cols: list[str]) -> DataFrame:
    """C4: (feature, level, n, default_rate), all categoricals in one aggregate."""
    long = df.select(F.col(target).alias("_y"), *[F.col(c).cast("string").alias(c) for c in categorical_cols]) \
        .unpivot(["_y"], categorical_cols, "feature", "level")
    return long.groupBy("feature", "level").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("_y").cast("double")).alias("default_rate")
    ).orderBy("feature", F.desc("default_rate"))


def class_means_diff(df: DataFrame, target: str, numeric_cols: list[str]) -> DataFrame:
    """Per numeric feature mean for good (0) / default (1) and the
    difference default - good, rounded to 2 dp; one conditional pass."""
    y = F.col(target)
    aggs = []
    for c in numeric_cols:
        aggs += [F.avg(F.when(y == 0, F.col(c))).alias(f"{c}__0"), F.avg(F.when(y == 1, F.col(c))).alias(f"{c}__1")]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}__0`, `{c}__1`" for c in numeric_cols)
    long = wide.selectExpr(f"stack({len(numeric_cols)}, {stack}) as (feature, m0, m1)")
    return long.select("feature", np_round("m0", 2).alias("mean_good"), np_round("m1", 2).alias("mean_default"),
                       np_round(F.col("m1") - F.col("m0"), 2).alias("difference"))


def corr_pairs(df: DataFrame, cols: list[str], min_abs: float | None = None) -> DataFrame:
    """Pearson r for every pair i < j over the rows where both are
    not null; long output (feature_a, feature_b, r).  With ``min_abs`` only
    |r| > min_abs.

    One pass for any number of columns: each row gives its pairs inside the
    stage and the partial aggregate keyed by pair keeps one row per pair and
    task before the shuffle."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    if not pairs:
        return df.sparkSession.createDataFrame([], "feature_a string, feature_b string, r double")
    values = F.array(*[F.col(c).cast("double") for c in cols])
    others = F.expr(f"sequence(i + 1, {len(cols) - 1})")
    long = (df.select(values.alias("x")).select("x", F.explode(F.sequence(F.lit(0), F.lit(len(cols) - 2))).alias("i"))
            .select("x", "i", F.explode(others).alias("j"))
            .select("i", "j", F.get("x", F.col("i")).alias("a"), F.get("x", F.col("j")).alias("b")))
    names = F.array(*[F.lit(c) for c in cols])
    out = (long.groupBy("i", "j").agg(F.corr("a", "b").alias("r"))
           .select(F.get(names, F.col("i")).alias("feature_a"), F.get(names, F.col("j")).alias("feature_b"), "r"))
    if min_abs is not None:
        out = out.where(F.abs("r") > min_abs)
    return out


def describe(df: DataFrame, numeric_cols: list[str], local_limit: int | None = None) -> DataFrame:
    """(feature, count, mean, std, min, q25, q50, q75, max), 2 dp, exact
    quartiles (linear interpolation).  Two scans: moments and sketch, then
    the slots of the bracketed selection."""
    names = ["count", "mean", "std", "min", "max"]
    with CacheScope():
        got = select(df, numeric_cols, [0.25, 0.5, 0.75], local_limit=local_limit, extra={
            "count": F.count, "mean": lambda c: F.avg(c.cast("double")), "std": lambda c: F.stddev_samp(c.cast("double")),
            "min": lambda c: F.min(c.cast("double")), "max": lambda c: F.max(c.cast("double"))})
    rows = [(f, *[got.extra[(), f][n] for n in names], *[float(v) for v in got.values[(), f]]) for f in numeric_cols if ((), f) in got.values]
    t = df.sparkSession.createDataFrame(rows, "feature string, count long, mean double, std double, min double, max double, "
                                              "q25 double, q50 double, q75 double")   # one row a feature
    return t.select("feature", "count", *[np_round(c, 2).alias(c) for c in ["mean", "std", "min", "q25", "q50", "q75", "max"]])


def iqr_outliers(df: DataFrame, numeric_cols: list[str], k: float = 1.5,
                 local_limit: int | None = None) -> DataFrame:
    """Q1/Q3 (exact, linear), bounds Q -/+ k IQR, strict outlier counts.

    Two scans for the quartiles, one that counts against the bounds
    (features x 2 literals); nulls count for the row total."""
    spark = df.sparkSession
    with CacheScope():
        qs = select(df, numeric_cols, [0.25, 0.75], local_limit=local_limit).values
    bounds = [(c, q[0], q[1], q[0] - k * (q[1] - q[0]), q[1] + k * (q[1] - q[0])) for c in numeric_cols if (q := qs.get(((), c))) is not None]
    counted = [F.count(F.lit(1)).alias("n")]
    for i, (c, _, _, lower, upper) in enumerate(bounds):
        x = F.col(c).cast("double")
        counted.append(F.count(F.when((x < lower) | (x > upper), 1)).alias(f"o{i}"))
    r = df.agg(*counted).first()   # one row
    rows = [(*b, r[f"o{i}"], r["n"]) for i, b in enumerate(bounds)]
    t = spark.createDataFrame(rows, "feature string, q1 double, q3 double, lower double, upper double, outliers long, n long")
    return t.select("feature", "q1", "q3", np_round("lower", 2).alias("lower_bound"), np_round("upper", 2).alias("upper_bound"),
                    "outliers", np_round(F.col("outliers") * 100.0 / F.col("n"), 2).alias("outlier_pct"))


def histogram_by_class(df: DataFrame, col: str, target: str, bins: int = 20) -> DataFrame:
    """Equal-width histogram per class, numpy rule ([e_i, e_i+1), the
    last bin closed); density = n / (n_class * width).  Range from one
    aggregate row (fitted scalars)."""
    x = F.col(col).cast("double")
    mm = df.agg(F.min(x).alias("mn"), F.max(x).alias("mx")).first()
    mn, mx = float(mm["mn"]), float(mm["mx"])
    if mn == mx:
        mn, mx = mn - 0.5, mx + 0.5
    step = (mx - mn) / bins
    edges = [i * step + mn for i in range(bins)] + [mx]
    b = None
    for i in range(1, bins):
        b = F.when(x < edges[i], i - 1) if b is None else b.when(x < edges[i], i - 1)
    b = (b.otherwise(bins - 1) if b is not None else F.lit(0))
    counted = df.where(x.isNotNull()).groupBy(F.col(target).alias("target"), b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    e_arr = F.array(*[F.lit(e) for e in edges])
    # class sizes from the (bins x classes) counts: no second pass over rows
    out = counted.withColumn("n_class", F.sum("n").over(Window.partitionBy("target")))
    lo = F.element_at(e_arr, F.col("bin") + 1)
    hi = F.element_at(e_arr, F.col("bin") + 2)
    return out.select("target", F.col("bin").cast("int").alias("bin"), lo.alias("lo"), hi.alias("hi"), "n",
                      (F.col("n") / (F.col("n_class") * (hi - lo))).alias("density"))


def histograms_by_class(df: DataFrame, cols: list[str], target: str, bins: int = 20) -> DataFrame:
    """C8 for many columns: (feature, target, bin, lo, hi, n, density), the
    rule of ``histogram_by_class``.  The rows are read once, into counts per
    distinct value, which give the ranges and then the bins."""
    dist = _persist(unpivot_numeric(df, cols, ids=[target]).where(F.col("value").isNotNull())
                    .groupBy("feature", target, "value").agg(F.count(F.lit(1)).alias("rows")))
    mn, mx = F.min("value"), F.max("value")
    flat = mn == mx
    ranges = dist.groupBy("feature").agg(F.when(flat, mn - 0.5).otherwise(mn).alias("mn"), F.when(flat, mx + 0.5).otherwise(mx).alias("mx"))
    step = (F.col("mx") - F.col("mn")) / bins
    edge = lambda i: i * step + F.col("mn")
    inner = F.filter(F.sequence(F.lit(1), F.lit(bins - 1)), lambda i: F.col("value") >= edge(i)) if bins > 1 else F.array()
    b = (dist.join(F.broadcast(ranges), "feature").withColumn("bin", F.size(inner))   # features x 1 rows
         .groupBy("feature", F.col(target).alias("target"), "bin", "mn", "mx").agg(F.sum("rows").alias("n")))
    w = Window.partitionBy("feature", "target")   # bins x classes rows
    lo = edge(F.col("bin"))
    hi = F.when(F.col("bin") == bins - 1, F.col("mx")).otherwise(edge(F.col("bin") + 1))
    return (b.select("feature", "target", "bin", lo.alias("lo"), hi.alias("hi"), "n", F.sum("n").over(w).alias("n_class"))
            .select("feature", "target", "bin", "lo", "hi", "n", (F.col("n") / (F.col("n_class") * (F.col("hi") - F.col("lo")))).alias("density")))


def box_stats(df: DataFrame, numeric_cols: list[str], target: str, local_limit: int | None = None) -> DataFrame:
    """Per (feature, class): min, q1, median, q3, max, mean and
    1.5-IQR whisker ends (most extreme data inside the fences).  Two scans for
    the quartiles, with the moments in the first; one for the whiskers."""
    kept = df.select(F.col(target).alias("target"), *[F.col(c).cast("double").alias(c) for c in numeric_cols])
    with CacheScope():
        got = select(kept, numeric_cols, [0.25, 0.5, 0.75], ["target"], {"n": F.count, "min": F.min, "max": F.max, "mean": F.avg},
                     local_limit=local_limit)
    fence = {k: (q[0] - 1.5 * (q[2] - q[0]), q[2] + 1.5 * (q[2] - q[0])) for k, q in got.values.items()}
    ends = []
    for i, c in enumerate(numeric_cols):
        lo = hi = None
        for (group, name), (a, b) in fence.items():
            if name == c:
                own = F.col("target").eqNullSafe(F.lit(group[0]))
                lo = F.when(own, a) if lo is None else lo.when(own, a)
                hi = F.when(own, b) if hi is None else hi.when(own, b)
        if lo is not None:
            ends += [F.min(F.when(F.col(c) >= lo, F.col(c))).alias(f"a{i}"), F.max(F.when(F.col(c) <= hi, F.col(c))).alias(f"b{i}")]
    whisker = {r["target"]: r for r in kept.groupBy("target").agg(*ends).collect()} if ends else {}   # one row a class
    rows = [(c, group[0], x["n"], x["min"], *[float(v) for v in q], x["max"], x["mean"], whisker[group[0]][f"a{i}"], whisker[group[0]][f"b{i}"])
            for i, c in enumerate(numeric_cols) for (group, name), q in got.values.items() if name == c for x in [got.extra[group, c]]]
    kind = kept.schema["target"].dataType.simpleString()
    return df.sparkSession.createDataFrame(rows, f"feature string, target {kind}, n long, min double, q1 double, median double, q3 double, "
                                                 "max double, mean double, whisker_lo double, whisker_hi double")
