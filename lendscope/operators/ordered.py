"""Ordered prefix sums and exact quantiles without a single-task window.

``Window.orderBy(x)`` with no partition key pulls a whole table into one
task.  Everything here first aggregates to one row per distinct
(group, value), then computes running sums in one of two ways:

* small groups (largest group <= ``local_limit`` distinct rows): a window
  partitioned by the group key; the size check bounds what one task holds;
* large groups: cut each group into buckets along the order with
  boundaries from one ``percentile_approx`` aggregate (literals, so bucket
  ids are deterministic and retries need no checkpoint), run the windows
  per (group, bucket) -- one hash shuffle -- and add the totals of the
  preceding buckets from a small broadcast table (groups x buckets rows).

Both paths return identical results.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import fma

LOCAL_LIMIT = 1_000_000
ROWS_PER_RANGE = 2_000_000
_SCOPES: list = []


class CacheScope:
    """Unpersist the intermediate tables cached inside the block once the
    caller's action has run (for operators that collect a small result)."""

    def __enter__(self):
        self.frames = []
        _SCOPES.append(self)
        return self

    def __exit__(self, *exc):
        _SCOPES.remove(self)
        for f in self.frames:
            f.unpersist()
        return False


_LOOSE: list = []


def _persist(df: DataFrame) -> DataFrame:
    """Cache an intermediate table: until the enclosing scope ends or, for an
    operator that returns a lazy result, until ``release_cached``."""
    df = df.persist()
    (_SCOPES[-1].frames if _SCOPES else _LOOSE).append(df)
    return df


def release_cached() -> None:
    """Unpersist what earlier operators of this process left cached for their
    lazy results (a result that is still used is computed again)."""
    while _LOOSE:
        frame = _LOOSE.pop()
        if frame.sparkSession.sparkContext._jsc is not None:
            frame.unpersist()


def _order_col(name: str, ascending: bool):
    return F.col(name).asc_nulls_first() if ascending else F.col(name).desc_nulls_last()


def prefix_sums(df: DataFrame, group_cols: list[str], order_col: str, sum_cols: list[str],
                ascending: bool = True, local_limit: int | None = None) -> DataFrame:
    """Add ``cum_<c>`` (inclusive running sum in the given order) and
    ``tot_<c>`` (group total) for every c in ``sum_cols``.

    ``df`` must hold at most one row per (group_cols, order_col).
    """
    limit = LOCAL_LIMIT if local_limit is None else local_limit
    df = _persist(df)
    # the window path puts one group in one task: decide on the largest group
    sizes = df.groupBy(*group_cols).count().agg(F.max("count").alias("mx"), F.sum("count").alias("n")).first()
    n, largest = int(sizes["n"] or 0), int(sizes["mx"] or 0)
    if largest <= limit:
        w_run = (Window.partitionBy(*group_cols).orderBy(_order_col(order_col, ascending))
                 .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        w_all = Window.partitionBy(*group_cols)
        return df.select(
            "*",
            *[F.sum(c).over(w_run).alias(f"cum_{c}") for c in sum_cols],
            *[F.sum(c).over(w_all).alias(f"tot_{c}") for c in sum_cols],
        )
    return _prefix_sums_ranged(df, group_cols, order_col, sum_cols, ascending, largest)


def _bucket_key(df: DataFrame, order_col: str, ascending: bool):
    """A double that never decreases along the requested order: the order
    column (or its first field for a struct order), negated when
    descending; nulls and NaN mapped to the end Spark sorts them to."""
    col = F.col(order_col)
    dtype = df.schema[order_col].dataType
    if hasattr(dtype, "fields"):
        col = col.getField(dtype.fields[0].name)
    v = col.cast("double")
    inf = float("inf")
    if ascending:      # nulls first, NaN last
        return F.when(v.isNull(), -inf).when(F.isnan(v), inf).otherwise(v)
    return F.when(v.isNull(), inf).when(F.isnan(v), -inf).otherwise(-v)   # nulls last, NaN first


def _second_key(df: DataFrame, order_col: str):
    """Second field of a struct order, in its own type (or None)."""
    dtype = df.schema[order_col].dataType
    if not hasattr(dtype, "fields") or len(dtype.fields) < 2:
        return None
    return F.col(order_col).getField(dtype.fields[1].name)


def _cuts(rows: DataFrame, key: str, n_rows: int, parts: int, ascending: bool):
    """A column with the bucket (0..parts-1) of ``key`` among ``parts`` along
    its own order, for a key of any orderable type: boundaries are quantiles
    of a hash sample of about 200 values a bucket, so they depend on the data
    only.  Nulls come first in ascending order, last otherwise."""
    every = max(1, n_rows // (200 * parts))
    sample = sorted(r[0] for r in rows.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0).select(key).collect()
                    if r[0] is not None and r[0] == r[0])   # about 200 x parts values
    bounds = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []
    if not bounds:
        return None
    arr = F.array(*[F.lit(b) for b in bounds])
    above = F.size(F.filter(arr, lambda b: b <= F.col(key)))
    v = F.when(F.col(key).isNull(), 0).otherwise(above)
    return v if ascending else F.when(F.col(key).isNull(), len(bounds)).otherwise(F.lit(len(bounds)) - above)


def _prefix_sums_ranged(df, group_cols, order_col, sum_cols, ascending, largest):
    """Large groups: cut every group into buckets of about ``ROWS_PER_RANGE``
    rows along the order, run the windows per (group, bucket) -- one hash
    shuffle -- and add the totals of the preceding buckets, computed from the
    collected bucket totals (groups x buckets rows) and broadcast.  Bucket
    boundaries come from one ``percentile_approx`` aggregate and enter the
    plan as literals, so bucket ids are a function of the data: retries and
    lost executors recompute the same buckets without any checkpoint."""
    from pyspark.ml.feature import Bucketizer

    n_buckets = max(2, math.ceil(largest / ROWS_PER_RANGE))
    probs = [i / n_buckets for i in range(1, n_buckets)]
    keyed = df.withColumn("_k", _bucket_key(df, order_col, ascending))
    bounds = keyed.groupBy(*group_cols).agg(
        F.percentile_approx("_k", probs, max(10_000, 10 * n_buckets)).alias("_bounds")).collect()  # groups x buckets
    # Tied first-field values holding more than a bucket's worth of rows (a
    # hot score) are isolated in their own first-level bucket and split again
    # along the struct's second field, so no tie group lands in one task.
    second = _second_key(df, order_col)
    heavy = {}
    if second is not None:
        keyed = keyed.withColumn("_k2", second)
        hot = keyed.groupBy(*group_cols, "_k").count().where(F.col("count") > ROWS_PER_RANGE)
        n_sub = F.greatest(F.lit(2), F.ceil(F.col("count") / ROWS_PER_RANGE)).cast("int")
        for r in hot.select(*group_cols, "_k", n_sub.alias("m")).collect():   # <= rows / ROWS_PER_RANGE values
            heavy.setdefault(tuple(r[c] for c in group_cols), []).append((float(r["_k"]), int(r["m"])))
    # one Bucketizer per group, applied as columns of the same frame (binary
    # search per row and group), and a CASE picking the row's own group: one
    # linear plan over the cached input, no union of filtered copies
    b_expr, tmp = None, []
    sub_expr = None
    max_sub = 1 + max([m for hv in heavy.values() for _, m in hv] or [1])
    for i, row in enumerate(bounds):
        cond = F.lit(True)
        for c in group_cols:
            cond = cond & F.col(c).eqNullSafe(F.lit(row[c]))
        inner = {float(b) for b in row["_bounds"] or [] if b is not None and math.isfinite(b)}
        gkey = tuple(row[c] for c in group_cols)
        for v, _ in heavy.get(gkey, []):
            if math.isfinite(v):
                inner |= {v, math.nextafter(v, math.inf)}   # [v, next(v)) holds only v
        inner = sorted(inner)
        if inner:
            out = f"_bk{i}"
            keyed = Bucketizer(splits=[float("-inf")] + inner + [float("inf")], inputCol="_k", outputCol=out,
                               handleInvalid="keep").transform(keyed)
            val = F.col(out).cast("int")
            tmp.append(out)
        else:
            val = F.lit(0)
        b_expr = F.when(cond, val) if b_expr is None else b_expr.when(cond, val)
        for j, (v, m) in enumerate(heavy.get(gkey, [])):
            hit = cond & (F.col("_k") == v)
            cut = _cuts(keyed.where(hit), "_k2", m * ROWS_PER_RANGE, m, ascending)
            if cut is not None:
                sub_expr = F.when(hit, cut) if sub_expr is None else sub_expr.when(hit, cut)
    first_level = b_expr if b_expr is not None else F.lit(0)
    sub = sub_expr.otherwise(0) if sub_expr is not None else F.lit(0)
    bucketed = keyed.withColumn("_b", first_level * max_sub + sub).drop(*tmp, *(["_k2"] if second is not None else []))
    keys = [*group_cols, "_b"]
    w_loc = (Window.partitionBy(*keys).orderBy(_order_col(order_col, ascending))
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = bucketed.select("*", *[F.sum(c).over(w_loc).alias(f"_loc_{c}") for c in sum_cols])
    # per-(group, bucket) totals: groups x buckets rows, collected; the
    # offsets (totals of the preceding buckets) go back as a local table so
    # the big side is not joined with its own lineage (which would re-run it)
    b_tot = bucketed.groupBy(*keys).agg(*[F.sum(c).alias(f"_bt_{c}") for c in sum_cols])
    schema = b_tot.schema
    tot_rows = b_tot.collect()
    by_group: dict = {}
    for r in tot_rows:
        by_group.setdefault(tuple(r[c] for c in group_cols), []).append(r)
    off_rows = []
    for g, rows in by_group.items():
        rows.sort(key=lambda r: r["_b"])
        totals = {c: sum(r[f"_bt_{c}"] or 0 for r in rows) for c in sum_cols}
        run = {c: 0 for c in sum_cols}
        for r in rows:
            off_rows.append((*g, r["_b"], *[run[c] for c in sum_cols], *[totals[c] for c in sum_cols]))
            for c in sum_cols:
                run[c] += r[f"_bt_{c}"] or 0
    from pyspark.sql.types import StructField, StructType

    fields = [StructField(f"_g_{c}", schema[c].dataType, True) for c in group_cols]
    fields.append(StructField("_g_b", schema["_b"].dataType, True))
    fields += [StructField(f"_off_{c}", schema[f"_bt_{c}"].dataType, True) for c in sum_cols]
    fields += [StructField(f"tot_{c}", schema[f"_bt_{c}"].dataType, True) for c in sum_cols]
    offsets = df.sparkSession.createDataFrame(off_rows, StructType(fields))
    cond = F.col("_b") == F.col("_g_b")
    for c in group_cols:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    joined = local.join(F.broadcast(offsets), cond, "inner")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_loc_{c}") + F.col(f"_off_{c}")).alias(f"cum_{c}") for c in sum_cols],
        *[F.col(f"tot_{c}") for c in sum_cols],
    )


def exact_quantiles(df: DataFrame, group_cols: list[str], value_col: str, probs: list[float],
                    local_limit: int | None = None, weight_col: str | None = None) -> DataFrame:
    """Linear-interpolation quantiles (pandas / ``quantile_cont`` rule), exact.

    Returns one row per (group, q_idx) with columns group..., q_idx, prob,
    q.  Nulls and NaN are skipped.  Work is linear in the rows and never
    holds one group's values in one task: values are counted per distinct
    value, positions come from distributed prefix sums, and each distinct
    value emits only the quantile positions it covers.
    """
    v = F.col(value_col)
    n_rows = F.sum(weight_col) if weight_col else F.count(F.lit(1))   # weight: rows per (pre-counted) value
    counts = (df.where(v.isNotNull() & ~F.isnan(v.cast("double")))
              .groupBy(*group_cols, value_col).agg(n_rows.cast("bigint").alias("cnt")))
    pre = prefix_sums(counts, group_cols, value_col, ["cnt"], local_limit=local_limit)
    n = F.col("tot_cnt")
    before = F.col("cum_cnt") - F.col("cnt")
    hits = []
    for j, p in enumerate(probs):
        h = (n - 1).cast("double") * F.lit(float(p))
        lo = F.floor(h)
        hi = F.ceil(h)
        cover_lo = (before <= lo) & (lo < F.col("cum_cnt"))
        cover_hi = (before <= hi) & (hi < F.col("cum_cnt"))
        hits.append(F.struct(F.lit(j).alias("q_idx"), F.lit(float(p)).alias("prob"), h.alias("h"),
                             F.when(cover_lo, v.cast("double")).alias("x_lo"),
                             F.when(cover_hi, v.cast("double")).alias("x_hi")))
    exploded = (pre.select(*group_cols, F.explode(F.filter(F.array(*hits),
                                                          lambda s: s["x_lo"].isNotNull() | s["x_hi"].isNotNull()))
                           .alias("s"))
                .select(*group_cols, "s.*"))
    agg = exploded.groupBy(*group_cols, "q_idx", "prob").agg(
        F.first("h").alias("h"), F.max("x_lo").alias("x_lo"), F.max("x_hi").alias("x_hi"))
    frac = F.col("h") - F.floor("h")
    # lo * (1 - frac) + hi * frac, the first product fused (bit-identical to
    # DuckDB's quantile_cont); equal neighbours give the value itself.
    lo_, hi_ = F.col("x_lo"), F.col("x_hi")
    q = F.when((frac == 0) | (lo_ == hi_), lo_).otherwise(fma(lo_, F.lit(1.0) - frac, hi_ * frac))
    return agg.select(*group_cols, "q_idx", "prob", q.alias("q"))


def quantile_columns(df: DataFrame, columns: list[str], probs: list[float],
                     local_limit: int | None = None) -> DataFrame:
    """Exact quantiles of many numeric columns in one job: long output
    (feature, q_idx, prob, q)."""
    long = unpivot_numeric(df, columns)
    return exact_quantiles(long, ["feature"], "value", probs, local_limit=local_limit)


def unpivot_numeric(df: DataFrame, columns: list[str], ids: list[str] | None = None) -> DataFrame:
    """(ids..., feature, value DOUBLE) with one row per input row and column."""
    ids = ids or []
    cast = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return cast.unpivot(ids, columns, "feature", "value")
