"""The portfolio's loss distribution without draws.

Defaults and LGD are independent across loans, so the logarithm of the loss's
characteristic function is a sum over loans of log(1 - p + p S(t e)), with S
that of the LGD (Beta, as a Gauss quadrature of ``NODES`` points, which keeps
its first 2 ``NODES`` - 1 moments).  The book is read once: loans are banded
by exposure (geometric bands of ratio ``RATIO``) and PD (``PD_BANDS`` equal
bands), a band keeps nine sums of products of powers of the positions within
it, and these give the weights of a quadratic interpolation between the nodes
of the bands, so mean and variance are those of the loans themselves; the
third and higher cumulants carry an error of the cubed band width.  Loans so
large that a term could turn them around (``LARGE`` against the book's
standard deviation) are not banded but evaluated one by one, distributed.

The density on mean +- ``WIDTH`` standard deviations is a cosine series with
``TERMS`` coefficients taken from the characteristic function; CDF, VaR,
CVaR and economic capital are read from the series in closed form.  All
scenarios share the scan and the aggregate.  What leaves the executors is one
row of moments a scenario; the bands (some 10,000 rows for six decades of
exposures) and the coefficients stay tables.

Defined results: loans with null or negative PD, or null, zero or negative
exposure, have no loss; PDs times a multiplier are capped at 1; a scenario
without loans, or without variance, gives no rows.  The series is smooth, so
for a handful of loans, where the distribution has steps, it only follows
their trend.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import _persist
from .risk import Scenario

RATIO = 1.05
PD_BANDS = 32
NODES = 4
WIDTH = 12
TERMS = 96
#: A loan is large when its exposure passes this share of the standard deviation.
LARGE = 0.16
POINTS = 2400

_LOG = math.log(RATIO)
_POLY_E = (  # weights of exposure nodes RATIO ** -1, 1, RATIO as polynomials of z
    [x / ((1 / RATIO - 1) * (1 / RATIO - RATIO)) for x in (RATIO, -1 - RATIO, 1)],
    [x / ((1 - 1 / RATIO) * (1 - RATIO)) for x in (1, -RATIO - 1 / RATIO, 1)],
    [x / ((RATIO - 1 / RATIO) * (RATIO - 1)) for x in (1 / RATIO, -1 - 1 / RATIO, 1)])
_POLY_P = ([0.0, -0.5, 0.5], [1.0, 0.0, -1.0], [0.0, 0.5, 0.5])  # PD nodes -1, 0, 1 as polynomials of y


def beta_nodes(a: float, b: float, n: int = NODES) -> list[tuple[float, float]]:
    """(x, weight) of the Gauss quadrature for Beta(a, b) on [0, 1]."""
    al, be = b - 1, a - 1
    diag, off = [(be - al) / (al + be + 2)], []
    for i in range(1, n):
        s = 2 * i + al + be
        diag.append((be * be - al * al) / (s * (s + 2)))
        num = 4 * i * (i + al) * (i + be) * (i + al + be)
        off.append(math.sqrt(4 * (1 + al) * (1 + be) / (s * s * (s + 1)) if i == 1 else num / (s * s * (s + 1) * (s - 1))))
    x, v = np.linalg.eigh(np.diag(diag) + np.diag(off, 1) + np.diag(off, -1))
    return [((1 + float(t)) / 2, float(w) ** 2) for t, w in zip(x, v[0])]


def scenario_nodes(s: Scenario) -> list[tuple[float, float]]:
    """``NODES`` points of the scenario's LGD (a constant: its own, once)."""
    if s.lgd_const is not None:
        return [(s.lgd_const, 1.0 if i == 0 else 0.0) for i in range(NODES)]
    return beta_nodes(s.lgd_a, s.lgd_b)


def _sets(scenarios: list[Scenario]) -> list[tuple[float, float]]:
    """The distinct (PD multiplier, largest PD) of scenarios."""
    return sorted({(float(s.pd_mult), math.inf if s.pd_max is None else float(s.pd_max)) for s in scenarios})


def _set_of(s: Scenario, sets) -> int:
    return sets.index((float(s.pd_mult), math.inf if s.pd_max is None else float(s.pd_max)))


def _placed(df: DataFrame, pd_col: str, ead_col: str, sets) -> DataFrame:
    """(set, p, e, j, k): each loan once for each set, with its bands."""
    every = F.array(*[F.struct(F.lit(i).alias("set"), F.lit(m).alias("mult"), F.lit(t).alias("top")) for i, (m, t) in enumerate(sets)])
    rows = (df.select(F.col(pd_col).cast("double").alias("pd"), F.col(ead_col).cast("double").alias("e"))
            .where("pd >= 0 and e > 0").withColumn("s", F.explode(every)).where("pd <= s.top"))
    return (rows.select("s.set", F.least(F.col("pd") * F.col("s.mult"), F.lit(1.0)).alias("p"), "e")
            .withColumn("j", F.round(F.ln("e") / F.lit(_LOG)).cast("int"))
            .withColumn("k", F.least(F.greatest(F.round(F.col("p") * PD_BANDS), F.lit(1)), F.lit(PD_BANDS - 1)).cast("int")))


def loss_bands(df: DataFrame, pd_col: str, ead_col: str, sets) -> DataFrame:
    """(set, j, k, s00 .. s22): the sums of z ** a * y ** b in each band."""
    z, y = F.col("e") / F.pow(F.lit(RATIO), F.col("j")), F.col("p") * PD_BANDS - F.col("k")
    rows = _placed(df, pd_col, ead_col, sets).select("set", "j", "k", z.alias("z"), y.alias("y"))
    power = {0: lambda c: F.lit(1.0), 1: F.col, 2: lambda c: F.col(c) * F.col(c)}
    return rows.groupBy("set", "j", "k").agg(*[F.sum(power[a]("z") * power[b]("y")).alias(f"s{a}{b}") for a in range(3) for b in range(3)])


def band_moments(bands: DataFrame) -> DataFrame:
    """(set, pe, pe2, p2e2): the sums of p e, p e^2 and p^2 e^2 over loans."""
    r, k = F.pow(F.lit(RATIO), F.col("j")), F.col("k")
    return bands.groupBy("set").agg(
        F.sum(r / PD_BANDS * (k * F.col("s10") + F.col("s11"))).alias("pe"),
        F.sum(r * r / PD_BANDS * (k * F.col("s20") + F.col("s21"))).alias("pe2"),
        F.sum(r * r / PD_BANDS ** 2 * (k * k * F.col("s20") + 2 * k * F.col("s21") + F.col("s22"))).alias("p2e2"))


def _terms(cells: DataFrame, frames: DataFrame) -> DataFrame:
    """(scenario, n, size, turn): log-modulus and argument of the
    characteristic function at term n, summed over weighted (set, e, p) cells."""
    # few bytes but much arithmetic: spread over all cores
    spread = cells.repartition(cells.sparkSession.sparkContext.defaultParallelism)
    rows = (spread.join(F.broadcast(frames), "set").where("single = (e_band > cut)")   # one row a scenario
            .withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(TERMS - 1)))))
    angle = F.col("n") * F.lit(math.pi) / (F.lit(2.0 * WIDTH) * F.col("sd")) * F.col("e")
    nodes = [F.col("nodes")[i] for i in range(NODES)]
    rows = rows.select("scenario", "n", "w", "p", angle.alias("angle"), "nodes")
    c = sum((x["w"] * F.cos(F.col("angle") * x["x"]) for x in nodes), F.lit(0.0))
    s = sum((x["w"] * F.sin(F.col("angle") * x["x"]) for x in nodes), F.lit(0.0))
    rows = rows.select("scenario", "n", "w", (1 - F.col("p") + F.col("p") * c).alias("re"), (F.col("p") * s).alias("im"))
    return rows.groupBy("scenario", "n").agg(
        F.sum(F.col("w") * 0.5 * F.ln(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("size"),
        F.sum(F.col("w") * F.atan2("im", "re")).alias("turn"))


class LossModel:
    """The fitted loss distributions of scenarios: ``series`` (scenario, n,
    coef) and ``frames`` (scenario, set, el, sd, lo, hi, nodes, cut)."""

    def __init__(self, df: DataFrame, pd_col: str, ead_col: str, scenarios: list[Scenario]):
        spark = df.sparkSession
        sets = _sets(scenarios)
        bands = _persist(loss_bands(df, pd_col, ead_col, sets))
        got = {r["set"]: r for r in band_moments(bands).collect()}   # one row a set
        frames = []
        for s in scenarios:
            nodes, m = scenario_nodes(s), got.get(_set_of(s, sets))
            l1, l2 = sum(w * x for x, w in nodes), sum(w * x * x for x, w in nodes)
            var = 0.0 if m is None else l2 * m["pe2"] - l1 * l1 * m["p2e2"]
            if var <= 0:
                continue
            sd, el = math.sqrt(var), l1 * m["pe"]
            frames.append((s.name, _set_of(s, sets), el, sd, el - WIDTH * sd, el + WIDTH * sd, nodes, math.floor(math.log(LARGE * sd) / _LOG)))
        self.frames = spark.createDataFrame(frames, "scenario string, set int, el double, sd double, lo double, hi double, "
                                                    "nodes array<struct<x:double,w:double>>, cut int")
        cut = min((f[-1] for f in frames), default=0)
        poly = lambda c, a, b: sum((F.col(f"s{m}{n}") * (_POLY_E[a][m] * _POLY_P[b][n]) for m in range(3) for n in range(3)), F.lit(0.0))
        spread = bands.select("set", F.col("j").alias("e_band"), F.explode(F.array(*[
            F.struct((F.col("j") + a - 1).alias("j"), (F.col("k") + b - 1).alias("k"), poly(F.col, a, b).alias("w"))
            for a in range(3) for b in range(3)])).alias("c"))
        # which frame counts a band depends on the frame's cut, so the band stays in the key
        nodes = (spread.groupBy("set", "e_band", "c.j", "c.k").agg(F.sum("c.w").alias("w"))
                 .select("set", "e_band", F.lit(False).alias("single"), "w", F.pow(F.lit(RATIO), F.col("j")).alias("e"),
                         (F.col("k") / F.lit(float(PD_BANDS))).alias("p")))
        singles = (_placed(df.where(F.col(ead_col) > RATIO ** (cut - 1)), pd_col, ead_col, sets)
                   .select("set", F.col("j").alias("e_band"), F.lit(True).alias("single"), F.lit(1.0).alias("w"), "e", "p"))
        sums = (_terms(nodes, self.frames).unionByName(_terms(singles, self.frames))
                .groupBy("scenario", "n").agg(F.sum("size").alias("size"), F.sum("turn").alias("turn")))
        shift = F.col("n") * F.lit(math.pi) * F.col("lo") / (F.col("hi") - F.col("lo"))
        coef = F.when(F.col("n") == 0, 1.0).otherwise(2.0) / (F.col("hi") - F.col("lo")) * F.exp("size") * F.cos(F.col("turn") - shift)
        self.series = _persist(sums.join(F.broadcast(self.frames), "scenario").select("scenario", "n", "lo", "hi", coef.alias("coef")))

    def _at(self, points: DataFrame, keys: list[str]) -> DataFrame:
        """``points`` (keys with scenario, x) with cdf, density and beyond (the
        mean of losses over x times their probability)."""
        w = F.col("n") * F.lit(math.pi) / (F.col("hi") - F.col("lo"))
        d, x, a = F.col("x") - F.col("lo"), F.col("x"), F.col("coef")
        first = F.col("n") == 0
        return points.join(F.broadcast(self.series), "scenario").groupBy(*keys, "x").agg(   # TERMS rows a scenario
            F.sum(F.when(first, a * d).otherwise(a / w * F.sin(w * d))).alias("cdf"), F.sum(a * F.cos(w * d)).alias("density"),
            F.sum(F.when(first, a * (F.col("hi") * F.col("hi") - x * x) / 2).otherwise(
                a * ((F.cos(F.col("n") * F.lit(math.pi)) - F.cos(w * d)) / (w * w) - x * F.sin(w * d) / w))).alias("beyond"))

    def distribution(self, points: int = 240) -> DataFrame:
        """(scenario, i, loss, cdf, density) on an even grid of losses."""
        grid = (self.frames.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points))))
                .select("scenario", "i", (F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / points).alias("x")).where("x >= 0"))
        return self._at(grid, ["scenario", "i"]).select(
            "scenario", "i", F.col("x").alias("loss"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "cdf")).alias("cdf"), "density")

    def metrics(self, levels: tuple[float, ...] = (0.95, 0.99), points: int = POINTS) -> DataFrame:
        """(scenario, el, std, var_95, var_99, cvar_95, cvar_99, ec_95,
        ec_99): VaR by interpolation on a grid of ``points``, CVaR from the
        series at the VaR, EC = VaR - EL."""
        grid = self.distribution(points)
        out = self.frames.select("scenario", "el", F.col("sd").alias("std"))
        point = F.struct("loss", "cdf")
        for q in levels:
            name = f"{q * 100:g}"
            ends = grid.groupBy("scenario").agg(F.max(F.when(F.col("cdf") < q, point)).alias("u"), F.min(F.when(F.col("cdf") >= q, point)).alias("v"))
            at = ends.select("scenario", (F.col("u.loss") + (q - F.col("u.cdf")) / (F.col("v.cdf") - F.col("u.cdf"))
                                          * (F.col("v.loss") - F.col("u.loss"))).alias("x"))
            got = self._at(at, ["scenario"]).select("scenario", F.col("x").alias(f"var_{name}"), (F.col("beyond") / (1 - q)).alias(f"cvar_{name}"))
            out = out.join(got, "scenario")
        names = [f"{q * 100:g}" for q in levels]
        return out.select("scenario", "el", "std", *[f"var_{n}" for n in names], *[f"cvar_{n}" for n in names],
                          *[(F.col(f"var_{n}") - F.col("el")).alias(f"ec_{n}") for n in names])

    def tail(self, level: float = 0.99, points: int = 240) -> DataFrame:
        """The grid's losses at or beyond the VaR of ``level``."""
        return self.distribution(points).where(F.col("cdf") >= level)


def oracle_ctes(scenarios: list[Scenario], src: str = "loan_book", pd_col: str = "pd", ead_col: str = "credit_amount",
                points: int = POINTS) -> str:
    """The same in SQL, as CTEs ``ld_frame``, ``ld_series``, ``ld_grid`` and
    ``ld_metrics`` (VaR and CVaR at 95 and 99 %)."""
    sets = _sets(scenarios)
    rows = ", ".join(f"({i}, CAST({m!r} AS DOUBLE), CAST({'2.0' if t == math.inf else repr(t)} AS DOUBLE))" for i, (m, t) in enumerate(sets))
    nodes = ", ".join(f"('{s.name}', {_set_of(s, sets)}, CAST({x!r} AS DOUBLE), CAST({w!r} AS DOUBLE))" for s in scenarios for x, w in scenario_nodes(s))
    ze = " UNION ALL ".join(f"SELECT {a - 1} AS da, {e[0]!r} + {e[1]!r} * z + {e[2]!r} * z * z AS we" for a, e in enumerate(_POLY_E))
    yp = " UNION ALL ".join(f"SELECT {b - 1} AS db, {p[0]!r} + {p[1]!r} * y + {p[2]!r} * y * y AS wp" for b, p in enumerate(_POLY_P))
    at = """sum(CASE WHEN n = 0 THEN coef * (x - lo) ELSE coef / (n * pi() / (hi - lo)) * sin(n * pi() / (hi - lo) * (x - lo)) END)"""
    return f"""
, ld_set AS (SELECT * FROM (VALUES {rows}) v("set", mult, top))
, ld_node AS (SELECT * FROM (VALUES {nodes}) v(scenario, "set", x, w))
, ld_loan AS (SELECT "set", p, e, CAST(round(ln(e) / CAST({_LOG!r} AS DOUBLE)) AS INTEGER) AS j,
    CAST(least(greatest(round(p * {PD_BANDS}), 1), {PD_BANDS - 1}) AS INTEGER) AS k
  FROM (SELECT s."set", least({pd_col} * s.mult, 1.0) AS p, CAST({ead_col} AS DOUBLE) AS e FROM {src}, ld_set s
        WHERE {pd_col} >= 0 AND {ead_col} > 0 AND {pd_col} <= s.top) q)
, ld_moment AS (SELECT "set", sum(p * e) AS pe, sum(p * e * e) AS pe2, sum(p * p * e * e) AS p2e2 FROM ld_loan GROUP BY "set")
, ld_lgd AS (SELECT scenario, "set", sum(w * x) AS l1, sum(w * x * x) AS l2 FROM ld_node GROUP BY ALL)
, ld_sd AS (SELECT l.scenario, l."set", l1 * pe AS el, sqrt(l2 * pe2 - l1 * l1 * p2e2) AS sd FROM ld_lgd l JOIN ld_moment m ON m."set" = l."set")
, ld_frame AS (SELECT scenario, "set", el, sd, el - {WIDTH} * sd AS lo, el + {WIDTH} * sd AS hi,
    CAST(floor(ln({LARGE} * sd) / CAST({_LOG!r} AS DOUBLE)) AS INTEGER) AS cut FROM ld_sd)
, ld_place AS (SELECT "set", j, k, p, e, e / pow(CAST({RATIO} AS DOUBLE), j) AS z, p * {PD_BANDS} - k AS y FROM ld_loan)
, ld_band AS (SELECT "set", j AS e_band, false AS single, sum(we * wp) AS w, pow(CAST({RATIO} AS DOUBLE), j + da) AS e, CAST(k + db AS DOUBLE) / {PD_BANDS} AS p
  FROM ld_place, LATERAL ({ze}) a, LATERAL ({yp}) b GROUP BY "set", j, j + da, k + db)
, ld_cell AS (SELECT * FROM ld_band UNION ALL SELECT "set", j, true, 1.0, e, p FROM ld_loan)
, ld_part AS (SELECT f.scenario, n, c.w, c.p, sum(d.w * cos(n * pi() / ({2 * WIDTH}.0 * sd) * e * d.x)) AS cs, sum(d.w * sin(n * pi() / ({2 * WIDTH}.0 * sd) * e * d.x)) AS sn
  FROM (SELECT *, row_number() OVER () AS id FROM ld_cell) c JOIN ld_frame f ON f."set" = c."set" AND c.single = (c.e_band > f.cut)
  JOIN ld_node d ON d.scenario = f.scenario, range({TERMS}) r(n) GROUP BY f.scenario, n, c.id, c.w, c.p)
, ld_sum AS (SELECT scenario, n, sum(w * 0.5 * ln((1 - p + p * cs) * (1 - p + p * cs) + p * sn * p * sn)) AS size, sum(w * atan2(p * sn, 1 - p + p * cs)) AS turn FROM ld_part GROUP BY ALL)
, ld_series AS (SELECT f.scenario, n, lo, hi, CASE WHEN n = 0 THEN 1.0 ELSE 2.0 END / (hi - lo) * exp(size) * cos(turn - n * pi() * lo / (hi - lo)) AS coef
  FROM ld_sum s JOIN ld_frame f ON f.scenario = s.scenario)
, ld_grid AS (SELECT scenario, i, x AS loss, greatest(0.0, least(1.0, {at})) AS cdf, sum(coef * cos(n * pi() / (hi - lo) * (x - lo))) AS density
  FROM (SELECT f.scenario, i, s.n, s.coef, f.lo, f.hi, f.lo + i * (f.hi - f.lo) / {points} AS x FROM ld_frame f JOIN ld_series s ON s.scenario = f.scenario, range({points} + 1) r(i)) g
  WHERE x >= 0 GROUP BY scenario, i, x)
, ld_end AS (SELECT scenario, q, max(CASE WHEN cdf < q THEN loss END) AS x0, max(CASE WHEN cdf < q THEN cdf END) AS f0,
    min(CASE WHEN cdf >= q THEN loss END) AS x1, min(CASE WHEN cdf >= q THEN cdf END) AS f1 FROM ld_grid, (VALUES (CAST(0.95 AS DOUBLE)), (CAST(0.99 AS DOUBLE))) v(q) GROUP BY scenario, q)
, ld_var AS (SELECT scenario, q, x0 + (q - f0) / (f1 - f0) * (x1 - x0) AS x FROM ld_end)
, ld_es AS (SELECT v.scenario, q, x, sum(CASE WHEN n = 0 THEN coef * (hi * hi - x * x) / 2 ELSE coef * ((cos(n * pi()) - cos(n * pi() / (hi - lo) * (x - lo))) / (n * pi() / (hi - lo)) / (n * pi() / (hi - lo))
    - x * sin(n * pi() / (hi - lo) * (x - lo)) / (n * pi() / (hi - lo))) END) / (1 - q) AS es FROM ld_var v JOIN ld_series s ON s.scenario = v.scenario GROUP BY v.scenario, q, x)
, ld_metrics AS (SELECT f.scenario, f.el, f.sd, a.x AS var_95, b.x AS var_99, a.es AS cvar_95, b.es AS cvar_99, a.x - f.el AS ec_95, b.x - f.el AS ec_99
  FROM ld_frame f JOIN ld_es a ON a.scenario = f.scenario AND a.q < 0.97 JOIN ld_es b ON b.scenario = f.scenario AND b.q > 0.97)
"""
