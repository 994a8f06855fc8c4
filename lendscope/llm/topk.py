"""Exact top-k search by multi-resolution segment statistics.

Each vector is cut into segments; a segment is described by its mean and its
deviation.  For two vectors the squared distance within a segment of n
components is at least n * ((m - m')^2 + (s - s')^2), which, with the vectors'
norms, bounds their inner product from above.  The bounds are taken over few
long segments first and over ever shorter ones for the candidates that remain;
the survivors' scores are computed exactly in integers.  A candidate is left
out only when its bound is below the k-th best exact score found so far, so
the result is exact, ties included (smaller id first).

Plan: candidates are cut into groups of about ``GROUP`` rows and queries into
blocks of about ``GROUP`` by a hash of the id; each (block, group) pair is a
task's work and returns at most k rows per query, a window over these gives
the final ranks.  Queries with equal ids count as one query (the row with the
smallest vector in order); a query isn't compared with rows of its own id.

Defined results: vectors that are null, empty, or hold null or non-finite
components take no part, neither do rows with a null id; vectors are compared
only with those of equal dimension; scores are 64-bit integers: where sums of
products could pass 64 bits they are taken in Python's integers, and a score
or scaled component that doesn't fit in 64 bits is an error, never cut.  Fewer
than k candidates: all of them; empty tables give no rows; ties go to the
smaller id; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import bounded_batches

GROUP = 16384
SEGMENTS = (4, 16)
CHUNK = 2048


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(n) * (means, deviations) of each segment: the inner product of two
    such rows bounds the vectors' inner product from above."""
    dim = x.shape[1]
    cuts = [dim * i // segments for i in range(segments + 1)]
    out = np.empty((len(x), 2 * segments))
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = x[:, a:b]
        n = max(b - a, 1)
        out[:, 2 * i] = part.sum(axis=1) / np.sqrt(n)
        out[:, 2 * i + 1] = np.sqrt(np.maximum((part * part).sum(axis=1) - out[:, 2 * i] ** 2, 0.0))
    return out


def lower_bounds(q_stat, q_norm, c_stat, c_norm) -> np.ndarray:
    """Lower bounds of squared distances from segment statistics."""
    return q_norm[:, None] + c_norm[None, :] - 2 * (q_stat @ c_stat.T)


def exact_scores(c: np.ndarray, q: np.ndarray, bound: float) -> np.ndarray:
    """Integer inner products of the rows of ``c`` with ``q``; ``bound`` is
    the largest possible absolute sum, as a double."""
    if bound < 2.0 ** 62:
        return c @ q
    score = c.astype(object) @ q.astype(object)
    if any(abs(s) >= 1 << 63 for s in score):
        raise OverflowError("a score doesn't fit in 64 bits")
    return score.astype(np.int64)


def best(q_id, q, c_id, c, k: int):
    """(query, candidate, score) of the k best candidates of each query;
    q and c are integer matrices."""
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    levels = [s for s in SEGMENTS if s < q.shape[1]] or [1]
    qs, cs = [segment_statistics(qf, s) for s in levels], [segment_statistics(cf, s) for s in levels]
    qn, cn = (qf * qf).sum(axis=1), (cf * cf).sum(axis=1)
    out = []
    reach = float(np.abs(cf).max(initial=0.0)) * np.abs(qf).sum(axis=1)
    for i in range(len(q)):
        top_s, top_c, floor = np.empty(0, np.int64), np.empty(0, np.int64), None
        slack = 1e-9 * (qn[i] + cn.max(initial=0.0)) + 1.0  # rounding of the bounds
        lb = lower_bounds(qs[0][i:i + 1], qn[i:i + 1], cs[0], cn)[0]
        bound = (qn[i] + cn - lb) / 2 + slack
        order = np.argsort(-bound, kind="stable")
        for lo in range(0, len(order), CHUNK):
            idx = order[lo:lo + CHUNK]
            if floor is not None:
                if bound[idx[0]] < floor:
                    break
                idx = idx[bound[idx] >= floor]
                for qa, ca in zip(qs[1:], cs[1:]):
                    finer = (qn[i] + cn[idx] - lower_bounds(qa[i:i + 1], qn[i:i + 1], ca[idx], cn[idx])[0]) / 2 + slack
                    idx = idx[finer >= floor]
            idx = idx[c_id[idx] != q_id[i]]
            if not len(idx):
                continue
            score = np.concatenate([top_s, exact_scores(c[idx], q[i], reach[i])])
            who = np.concatenate([top_c, c_id[idx]])
            keep = np.lexsort((who, -score))[:k]
            top_s, top_c = score[keep], who[keep]
            floor = top_s[-1] if len(top_s) == k else None
        out += [(int(q_id[i]), int(a), int(s)) for a, s in zip(top_c, top_s)]
    return out


def _task(k: int):
    def run(table):
        ids, side = table["vec_id"].to_numpy(), table["side"].to_numpy()
        x = np.stack([np.asarray(v, dtype=np.int64) for v in table["v"].to_numpy()])
        q, c = side == 0, side == 1
        got = best(ids[q], x[q], ids[c], x[c], k) if q.any() and c.any() else []
        cols = list(zip(*got)) or [(), (), ()]
        return pa.table({n: pa.array(list(v), pa.int64()) for n, v in zip(("query_id", "vec_id", "score"), cols)})
    return run


def search(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of
    each query (rows where ``is_query``) over floor(scale * component)."""
    bounded_batches(vectors.sparkSession)
    limit = float(1 << 63)

    def whole(x):
        y = x * scale
        return F.when(F.abs(y) < limit, F.floor(y)).otherwise(F.raise_error(F.lit("a scaled component doesn't fit in 64 bits")).cast("long"))

    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    fine = (F.col("vec_id").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0)
            & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    src = (src.where(F.coalesce(fine, F.lit(False)))
           .select("vec_id", F.transform("e", whole).alias("v"),
                   F.size("e").alias("dim")))
    queries = src.where(is_query).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("x")).select("vec_id", "x.dim", "x.v")
    sizes = {r["side"]: r["n"] for r in src.agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(1))
             .unionByName(queries.agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(0))).collect()}
    groups, blocks = -(-max(sizes[1], 1) // GROUP), -(-max(sizes[0], 1) // GROUP)
    own = F.pmod(F.xxhash64("vec_id", "v"), F.lit(groups)).cast("int")
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    left = queries.select("vec_id", "v", "dim", F.lit(0).alias("side"), block.alias("block"), F.explode(every(groups)).alias("grp"))
    right = src.select("vec_id", "v", "dim", F.lit(1).alias("side"), F.explode(every(blocks)).alias("block"), own.alias("grp"))
    part = (left.unionByName(right.select(*left.columns)).groupBy("dim", "block", "grp")
            .applyInArrow(_task(k), "query_id long, vec_id long, score long"))
    rank = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (part.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
