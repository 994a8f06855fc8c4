"""Portfolio risk (I1-I13): expected loss, Monte-Carlo loss distribution,
VaR / CVaR / economic capital, LGD sensitivity, PD stress, policy what-if.

Monte Carlo at scale
--------------------
Loans are cut into blocks by ``pmod(xxhash64(key), B)`` with B chosen from
the loan count so a block holds at most ``block_rows`` loans (no hot
group: the key is unique).  Rows are range-partitioned on the block and
sorted by (block, key); a ``mapInPandas`` task streams its blocks and draws
with NumPy's SFC64 generator seeded by (seed, stream, block).  Draws are
therefore a function of the data and the seed -- not of partitioning,
retries or executor loss.  Each task adds its blocks' losses into one
vector per scenario and emits n_sims rows per scenario; a hash aggregate
sums the partitions to the loss per (scenario, simulation).  The number of
tasks follows the cores, not the book, so these rows don't grow with it.

Every loan is drawn in every simulation.  A default takes one random byte a
cell: below the first 8 bits of the PD it is one, above them it is none, and
if equal (one cell in 256) a further uniform against the PD's other bits
decides, so the probability is the PD to all its bits.  LGD is drawn only for
defaulted cells, by the inverse of the Beta CDF (``beta_inverse``).

Default and LGD draws use separate streams: LGD-sensitivity scenarios share
the base run's default draws (common random numbers), which are made once for
all of them; stress and policy scenarios get fresh draws, a policy those of
the loans that it approves.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import np_round
from .binning import with_equal_width_bins
from .ordered import _persist, exact_quantiles, prefix_sums

# Functions of this module run inside Python workers (mapInPandas); ship them
# by value so executors need only NumPy/pandas, not this package.
try:
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except (ImportError, AttributeError, ValueError):  # pragma: no cover
    pass


# LGD mean and standard deviation, number of simulations.
LGD_MEAN, LGD_STD = 0.45, 0.10
N_SIMULATIONS = 10_000


def beta_params(mean: float, sd: float, adjust: bool = False) -> tuple[float, float]:
    """I4: method-of-moments Beta parameters; ``adjust`` applies abs(.)+0.01
    (the sensitivity variant)."""
    k = mean * (1 - mean) / sd ** 2 - 1
    a, b = mean * k, (1 - mean) * k
    if adjust:
        a, b = abs(a) + 0.01, abs(b) + 0.01
    return a, b


@dataclass
class Scenario:
    name: str
    pd_mult: float = 1.0
    lgd_a: float = 0.0
    lgd_b: float = 0.0
    lgd_const: float | None = None     # constant LGD instead of Beta draws
    pd_max: float | None = None        # policy: only loans with PD <= pd_max
    u_stream: int = 0
    b_stream: int = 1
    params: dict = field(default_factory=dict)


def base_scenario(name="base", mean=LGD_MEAN, sd=LGD_STD) -> Scenario:
    a, b = beta_params(mean, sd)
    return Scenario(name, 1.0, a, b, u_stream=0, b_stream=1, params={"lgd": mean})


def lgd_sensitivity_scenarios(lgds=(0.25, 0.35, 0.45, 0.55, 0.65, 0.75), sd=LGD_STD) -> list[Scenario]:
    """I8: same default draws as the base run (u_stream 0), fresh LGD draws."""
    out = []
    for i, m in enumerate(lgds):
        a, b = beta_params(m, sd, adjust=True)
        out.append(Scenario(f"lgd_{m:.2f}", 1.0, a, b, u_stream=0, b_stream=100 + i, params={"lgd": m}))
    return out


# PD multipliers of the stress scenarios, PD thresholds of the credit policies.
STRESS = [("Base Case", 1.0), ("Mild Stress", 1.25), ("Moderate", 1.50), ("Severe", 2.00), ("Extreme", 3.00)]
POLICY_THRESHOLDS = (0.10, 0.20, 0.30, 0.40, 0.50)


def stress_scenarios(mults=STRESS, mean=LGD_MEAN, sd=LGD_STD) -> list[Scenario]:
    """PD x multiplier clipped to 1, fresh draws per scenario."""
    a, b = beta_params(mean, sd)
    return [Scenario(name, m, a, b, u_stream=200 + i, b_stream=300 + i, params={"pd_mult": m})
            for i, (name, m) in enumerate(mults)]


def policy_scenarios(thresholds=POLICY_THRESHOLDS, mean=LGD_MEAN, sd=LGD_STD) -> list[Scenario]:
    """Approve PD <= t, fresh draws per threshold."""
    a, b = beta_params(mean, sd)
    return [Scenario(f"pd_le_{t:.2f}", 1.0, a, b, pd_max=t, u_stream=400 + i, b_stream=500 + i,
                     params={"pd_threshold": t}) for i, t in enumerate(thresholds)]


# ---------------------------------------------------------------- per-loan
def expected_loss(df: DataFrame, key: str, pd_col: str, ead_col: str, lgd: float = LGD_MEAN,
                  keep: list[str] | None = None) -> DataFrame:
    """(key, ..., PD, EAD, LGD, EL)."""
    keep = keep or []
    return df.select(F.col(key), *[F.col(c) for c in keep], F.col(pd_col).alias("PD"),
                     F.col(ead_col).cast("double").alias("EAD"), F.lit(lgd).alias("LGD"),
                     (F.col(pd_col) * lgd * F.col(ead_col)).alias("EL"))


def scenario_moments(df: DataFrame, pd_col: str, ead_col: str, scenarios: list[tuple]) -> DataFrame:
    """I8-I10, I12 in closed form: (scenario, mult, pd_max, l1, n_loans, ead,
    mean_pd, el, std) for scenarios (name, PD multiplier, largest PD approved,
    mean and second moment of LGD).

    Defaults and LGD are independent across loans, so the loss has the mean
    sum p m ead and the variance sum ead^2 (p m2 - (p m)^2).  One pass: the
    scenarios expand inside the stage and are summed before the shuffle."""
    s = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(m).alias("mult"), F.lit(t).alias("pd_max"),
                           F.lit(l1).alias("l1"), F.lit(l2).alias("l2")) for n, m, t, l1, l2 in scenarios])
    rows = df.select(F.col(pd_col).alias("pd"), F.col(ead_col).cast("double").alias("ead"), F.explode(s).alias("s")).select("pd", "ead", "s.*")
    p, e = F.least(F.col("pd") * F.col("mult"), F.lit(1.0)), F.col("ead")
    m1 = p * F.col("l1")
    return rows.where("pd <= pd_max").groupBy("scenario", "mult", "pd_max", "l1").agg(
        F.count(F.lit(1)).alias("n_loans"), F.sum(e).alias("ead"), F.avg(p).alias("mean_pd"), F.sum(m1 * e).alias("el"),
        F.sqrt(F.sum(e * e * (p * F.col("l2") - m1 * m1))).alias("std"))


def portfolio_summary(port: DataFrame) -> DataFrame:
    """I2."""
    return port.agg(F.count(F.lit(1)).alias("n_loans"), F.sum("EAD").alias("total_exposure"),
                    F.avg("EAD").alias("avg_ead"), F.avg("PD").alias("avg_pd"), F.sum("EL").alias("total_el"),
                    (F.sum("EL") / F.sum("EAD")).alias("el_rate"))


def top_loans(port: DataFrame, key: str, n: int = 5) -> DataFrame:
    """I3 (ties by key)."""
    return port.orderBy(F.desc("EL"), F.col(key)).limit(n)


def el_by_pd_bucket(port: DataFrame, bins: int = 5) -> DataFrame:
    """Equal-width PD buckets (pd.cut rule), total EL per bucket."""
    b = with_equal_width_bins(port, "PD", bins, "bucket")
    return b.groupBy("bucket", "bucket_lo", "bucket_hi").agg(
        F.count(F.lit(1)).alias("n_loans"), F.sum("EL").alias("total_el"))


# ---------------------------------------------------------------- Monte Carlo
LGD_BITS = 14    # small enough a table for a core's own cache
LGD_CELLS = 1 << LGD_BITS
LGD_TAIL = 16    # cells at either end of the LGD table that are not interpolated


def beta_inverse(a: float, b: float, panels: int = 1 << 18):
    """The inverse CDF of Beta(a, b): (values at i / LGD_CELLS, the CDF's fine
    grid, its values), or None where the density has a pole (a or b below 1).

    The CDF is integrated over ``panels`` panels of x = (1 - cos t) / 2, two
    Gauss points each."""
    if min(a, b) < 1:
        return None
    edge = np.linspace(0.0, np.pi, panels + 1)
    mid, half = (edge[1:] + edge[:-1]) / 2, np.pi / panels / 2
    top = (a - 1) / (a + b - 2) if a + b > 2 else 0.5
    peak = sum(c * math.log(v) for c, v in ((a - 1, top), (b - 1, 1 - top)) if c > 0)
    mass = np.zeros(panels)
    for t in (mid - half / math.sqrt(3), mid + half / math.sqrt(3)):
        x, y = np.sin(t / 2) ** 2, np.cos(t / 2) ** 2
        mass += np.exp((a - 1) * np.log(x) + (b - 1) * np.log(y) - peak) * np.sin(t)
    cdf = np.concatenate([[0.0], np.cumsum(mass)])
    cdf /= cdf[-1]
    grid = np.sin(edge / 2) ** 2
    return np.interp(np.arange(LGD_CELLS + 1) / LGD_CELLS, cdf, grid), cdf, grid


class _Draws:
    """Random integers of one stream of one block, whole words at a time."""

    def __init__(self, *key: int):
        self.bits = np.random.SFC64(np.random.SeedSequence(key))
        self.rng = np.random.Generator(self.bits)

    def ints(self, n: int, dtype) -> np.ndarray:
        size = np.dtype(dtype).itemsize
        return self.bits.random_raw(-(-n * size // 8)).view(dtype)[:n]


def _rare(flags: np.ndarray) -> np.ndarray:
    """Where ``flags`` is set, if few are: eight are looked at together."""
    whole = len(flags) & ~7
    word = np.flatnonzero(flags[:whole].view(np.uint64) != 0)
    at = (word[:, None] * 8 + np.arange(8)).ravel()
    at = at[flags.take(at)]
    return at if whole == len(flags) else np.concatenate([at, whole + np.flatnonzero(flags[whole:])])


def _buffers(n: int) -> tuple:
    """Memory for the draws of up to n cells, used again for each chunk."""
    return np.empty(n, dtype=np.intp), np.empty(n), np.empty(n)


def _draw_lgd(draws: _Draws, n: int, inverse, sc: Scenario, buffers: tuple | None = None) -> np.ndarray:
    """n Beta draws of 32 bits: the first LGD_BITS choose a cell of the inverse
    CDF, a line in all 32; the cells at both ends, where it is steep, use the
    fine grid."""
    if inverse is None:
        return draws.rng.beta(sc.lgd_a, sc.lgd_b, size=n)
    (start, step), cdf, grid = inverse
    u = draws.ints(n, np.uint32)
    left = 32 - LGD_BITS
    cell, out, part = (x[:n] for x in buffers or _buffers(n))
    np.right_shift(u, left, out=cell, casting="unsafe")
    step.take(cell, mode="clip", out=out)
    out *= u
    out += start.take(cell, mode="clip", out=part)
    ends = _rare(u + np.uint32(LGD_TAIL << left) < np.uint32(2 * LGD_TAIL << left))   # wraps around: both ends
    if len(ends):
        out[ends] = np.interp((u[ends] + 0.5) / 2.0 ** 32, cdf, grid)
    return out


def _inverses(scenarios: list[Scenario]) -> dict:
    """(a, b) -> ``beta_inverse`` as a line a cell (its value at the first of
    all 32-bit numbers, slope), once a task."""
    out = {}
    for sc in scenarios:
        if sc.lgd_const is None and (sc.lgd_a, sc.lgd_b) not in out:
            got = beta_inverse(sc.lgd_a, sc.lgd_b)
            if got is not None:
                slope = np.diff(got[0]) / (1 << 32 - LGD_BITS)
                first = np.arange(LGD_CELLS) * float(1 << 32 - LGD_BITS)
                got = (got[0][:-1] - slope * (first - 0.5), slope), got[1], got[2]
            out[sc.lgd_a, sc.lgd_b] = got
    return out


def _block_losses(pdf: pd.DataFrame, scenarios: list[Scenario], n_sims: int, seed: int,
                  cells_per_chunk: int, inverses: dict | None = None) -> dict[str, np.ndarray]:
    """Loss per simulation of one block of loans, per scenario."""
    inverses = _inverses(scenarios) if inverses is None else inverses
    pdf = pdf.sort_values("key", kind="mergesort")
    block = int(pdf["block"].iloc[0])
    pd_all = pdf["pd"].to_numpy(dtype=float)
    ead_all = pdf["ead"].to_numpy(dtype=float)
    out = {sc.name: np.zeros(n_sims) for sc in scenarios}
    shared: dict = {}
    for sc in scenarios:
        shared.setdefault((sc.u_stream, sc.pd_mult, sc.pd_max), []).append(sc)
    for (stream, mult, pd_max), group in shared.items():
        sel = np.ones(len(pd_all), dtype=bool) if pd_max is None else pd_all <= pd_max
        p, ead = np.nan_to_num(np.clip(pd_all[sel] * mult, 0.0, 1.0)) * 256, ead_all[sel]
        n = len(p)
        if n == 0:
            continue
        first = np.minimum(np.floor(p), 255)       # a PD of 1: 255 and all ties
        chunk = min(n_sims, max(1, cells_per_chunk // n))
        bound, rest, eads = np.tile(first.astype(np.uint8), chunk), np.tile(p - first, chunk), np.tile(ead, chunk)
        byte, tie = _Draws(seed, stream, block, 0), _Draws(seed, stream, block, 1)
        lgd = [_Draws(seed, sc.b_stream, block, 2) for sc in group]
        buffers, dues, flags = _buffers(chunk * n), np.empty(chunk * n), np.empty((2, chunk * n), dtype=bool)
        for c0 in range(0, n_sims, chunk):
            m = min(chunk, n_sims - c0)
            b = byte.ints(m * n, np.uint8)
            hit = np.less(b, bound[:m * n], out=flags[0, :m * n])
            same = _rare(np.equal(b, bound[:m * n], out=flags[1, :m * n]))
            hit[same] = tie.rng.random(len(same)) < rest.take(same)
            cells = np.flatnonzero(hit)
            at = np.searchsorted(cells, np.arange(m + 1) * n)      # where each simulation's defaults begin
            any_ = at[1:] > at[:-1]
            if not any_.any():
                continue
            due = eads.take(cells, mode="clip", out=dues[:len(cells)])
            for sc, draws in zip(group, lgd):
                w = np.multiply(due, sc.lgd_const if sc.lgd_const is not None
                                else _draw_lgd(draws, len(cells), inverses[sc.lgd_a, sc.lgd_b], sc, buffers), out=buffers[2][:len(cells)])
                out[sc.name][c0:c0 + m][any_] = np.add.reduceat(w, at[:-1][any_])
    return out


def _simulate_partition(batches, scenarios, n_sims, seed, cells_per_chunk):
    """Rows arrive sorted by (block, key); complete blocks are simulated as
    soon as the next block starts, and their losses are added into one
    vector per scenario, emitted once per partition (n_sims rows per
    scenario instead of per block)."""
    acc = {sc.name: np.zeros(n_sims) for sc in scenarios}
    inverses = _inverses(scenarios)
    buf = None
    seen = False
    for pdf in batches:
        if pdf.empty:
            continue
        buf = pdf if buf is None else pd.concat([buf, pdf], ignore_index=True)
        last = buf["block"].iloc[-1]
        done = buf[buf["block"] != last]
        if not done.empty:
            for _, blk in done.groupby("block", sort=True):
                for k, v in _block_losses(blk, scenarios, n_sims, seed, cells_per_chunk, inverses).items():
                    acc[k] += v
            buf = buf[buf["block"] == last].reset_index(drop=True)
        seen = True
    if buf is not None and not buf.empty:
        for k, v in _block_losses(buf, scenarios, n_sims, seed, cells_per_chunk, inverses).items():
            acc[k] += v
    if seen:
        for sc in scenarios:
            yield pd.DataFrame({"scenario": sc.name, "sim_id": np.arange(n_sims, dtype=np.int64),
                                "partial": acc[sc.name]})


def simulate_losses(df: DataFrame, key: str, pd_col: str, ead_col: str, scenarios: list[Scenario],
                    n_sims: int = N_SIMULATIONS, seed: int = 42, block_rows: int = 2_000,
                    cells_per_chunk: int = 1 << 17) -> DataFrame:
    """(scenario, sim_id, loss) for every scenario in one job."""
    n = df.count()
    n_blocks = max(1, math.ceil(n / block_rows))
    loans = df.select(F.col(key).alias("key"), F.col(pd_col).cast("double").alias("pd"),
                      F.col(ead_col).cast("double").alias("ead"),
                      F.pmod(F.xxhash64(F.col(key)), F.lit(n_blocks)).cast("int").alias("block"))
    scen = list(scenarios)

    def fn(batches):
        return _simulate_partition(batches, scen, n_sims, seed, cells_per_chunk)

    # Range partitioning on the block id keeps each block inside one
    # partition; an explicit count is not coalesced by AQE (blocks are
    # CPU-heavy although their input is small).  The count only spreads the
    # work: draws are keyed by block, so results do not depend on it.  A task
    # holds one block at a time and n_sims sums a scenario, however many
    # blocks it has; sixteen tasks a core keep the cores evenly busy, and the
    # rows that are shuffled (tasks x n_sims x scenarios) don't grow with the book.
    n_parts = max(1, min(-(-n_blocks // 4), 16 * df.sparkSession.sparkContext.defaultParallelism))
    ordered = loans.repartitionByRange(n_parts, "block").sortWithinPartitions("block", "key")
    partial = ordered.mapInPandas(fn, "scenario string, sim_id long, partial double")
    return partial.groupBy("scenario", "sim_id").agg(F.sum("partial").alias("loss"))


def risk_metrics(losses: DataFrame, group_cols: list[str] | None = None,
                 local_limit: int | None = None) -> DataFrame:
    """EL (mean), population std, VaR95/99 (linear percentile), CVaR95/99
    (mean of losses >= VaR), EC95/99 = VaR - EL."""
    g = group_cols or ["scenario"]
    losses = _persist(losses)   # used twice below; the simulation runs once
    q = exact_quantiles(losses, g, "loss", [0.95, 0.99], local_limit)
    qw = q.groupBy(*g).pivot("q_idx", [0, 1]).agg(F.first("q")).select(
        *g, F.col("0").alias("var_95"), F.col("1").alias("var_99"))
    j = losses.join(F.broadcast(qw), g)   # one row per scenario
    l = F.col("loss")
    m = j.groupBy(*g, "var_95", "var_99").agg(
        F.count(l).alias("n_sims"), F.avg(l).alias("el"), F.stddev_pop(l).alias("std"),
        F.avg(F.when(l >= F.col("var_95"), l)).alias("cvar_95"), F.avg(F.when(l >= F.col("var_99"), l)).alias("cvar_99"))
    return m.select(*g, "n_sims", "el", "std", "var_95", "var_99", "cvar_95", "cvar_99",
                    (F.col("var_95") - F.col("el")).alias("ec_95"), (F.col("var_99") - F.col("el")).alias("ec_99"))


def loss_cdf(losses: DataFrame, group_cols: list[str] | None = None, local_limit: int | None = None) -> DataFrame:
    """Sorted losses with cdf = rank / n (ties ranked by sim_id)."""
    g = group_cols or ["scenario"]
    rows = losses.select(*g, "sim_id", "loss", F.struct("loss", "sim_id").alias("_ord"),
                         F.lit(1).cast("bigint").alias("one"))
    pre = prefix_sums(rows, g, "_ord", ["one"], local_limit=local_limit)
    return pre.select(*g, "sim_id", "loss", F.col("cum_one").alias("rank"),
                      (F.col("cum_one") / F.col("tot_one")).alias("cdf"))


def tail_losses(losses: DataFrame, metrics: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Simulations with loss >= VaR99."""
    g = group_cols or ["scenario"]
    return losses.join(F.broadcast(metrics.select(*g, "var_99")), g).where(F.col("loss") >= F.col("var_99")) \
        .select(*g, "sim_id", "loss")


def risk_summary(port: DataFrame, metrics: DataFrame, scenario: str = "base") -> DataFrame:
    """I12 as a DataFrame (metric, value): one aggregate row unpivoted."""
    tot = port.agg(F.sum("EAD").alias("total_exposure"))
    m = metrics.where(F.col("scenario") == scenario)
    j = m.withColumn("_k", F.lit(1)).join(tot.withColumn("_k", F.lit(1)), "_k")
    wide = j.select(F.col("total_exposure"), F.col("el").alias("expected_loss"),
                    (F.col("el") / F.col("total_exposure")).alias("el_pct"), "var_95", "var_99", "cvar_99",
                    F.col("ec_99").alias("economic_capital_99"), F.col("n_sims").cast("double").alias("n_simulations"))
    names = ["total_exposure", "expected_loss", "el_pct", "var_95", "var_99", "cvar_99", "economic_capital_99",
             "n_simulations"]
    stack = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in names)
    return wide.selectExpr(f"stack({len(names)}, {stack}) as (metric, value)")


# ---------------------------------------------------------------- md5 variant
def md5_uniform(sim, key):
    """u in [0, 1) from the first 12 hex digits of md5(sim-key)."""
    d = F.md5(F.concat(sim.cast("string"), F.lit("-"), key.cast("string")))
    return F.conv(F.substring(d, 1, 12), 16, 10).cast("double") / float(1 << 48)


def simulate_losses_md5(df: DataFrame, key: str, pd_col: str, ead_col: str, n_sims: int,
                        lgd: float = LGD_MEAN) -> DataFrame:
    """Checkable Monte Carlo: u = md5(sim-key) / 2^48, constant LGD.  Each
    loan expands to its n_sims cells inside one stage and is summed by a
    partial aggregate before the shuffle, so only (task, sim) partial sums
    move.  Money is summed exactly (EAD in cents x LGD to 4 places, as whole
    thousands and millionths of the rest), so the loss does not depend on
    summation order.

    What a cell needs is made once a loan: u < p is a comparison of 12 hex
    digits with those of ceil(2^48 p), which is exact.  The slim loans are
    spread over all cores first, as few bytes make much work."""
    loans = df.select(F.col(key).alias("k"), F.col(pd_col).alias("p"),
                      (F.col(ead_col).cast("decimal(18,2)") * F.lit(lgd).cast("decimal(6,4)")).alias("el"))
    loans = loans.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, "k")
    below = (F.when(F.col("p") >= 1, F.lit("g"))     # above every digit
             .when(F.col("p") <= 0, F.lit("0" * 12))
             .when(F.col("p").isNotNull(), F.lpad(F.lower(F.hex(F.ceil(F.col("p") * float(1 << 48)))), 12, "0")))
    cells = loans.select("k", below.alias("below"), F.expr("el div 1000").alias("high"), F.expr("CAST((el % 1000) * 1000000 AS BIGINT)").alias("low"),
                         F.explode(F.sequence(F.lit(0), F.lit(n_sims - 1))).alias("sim_id"))
    digits = F.substring(F.md5(F.concat(F.col("sim_id").cast("string"), F.lit("-"), F.col("k").cast("string"))), 1, 12)
    hit = digits < F.col("below")
    sums = cells.select("sim_id", *[F.when(hit, F.col(c)).otherwise(F.lit(0).cast("bigint")).alias(c) for c in ("high", "low")]) \
        .groupBy("sim_id").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    loss = F.col("high").cast("decimal(20,0)") * 1000 + F.col("low").cast("decimal(20,0)") * F.lit("0.000001").cast("decimal(6,6)")
    return sums.select("sim_id", loss.cast("double").alias("loss"))
