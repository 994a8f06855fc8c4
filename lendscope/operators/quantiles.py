"""Exact quantiles by bracketed selection.

1. One scan takes a mergeable sketch (``percentile_approx``) of every column
   and group, and with it a bracket of values around each wanted rank.
2. A second scan sorts every value into slots: inside a bracket, or in a gap
   between brackets.  Gaps are one counted row each, bracket values are
   counted per distinct value, all combined on the map side, so what is
   shuffled are the some 0.04 % of values around each wanted rank.
3. The wanted order statistics are read from the counts: the end of a gap, the
   only value of a slot, or the prefix sums inside one bracket.

No task sorts a column and no table of all distinct values is made.  The slot
counts also are the counts of any bins whose edges are the quantiles, since an
edge lies in a bracket or at the end of a gap (``rep`` stands for all values
of a slot's row).  The sketch decides on speed only: a rank that lies inside a
gap makes that gap the bracket of another scan.

Nulls and NaN are skipped (in the slot table they are slot -1); groups without
values have no quantiles.  What reaches the driver are columns x groups x
quantiles numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import _persist, prefix_sums

#: 1 / rank error of the sketch; a bracket spans four errors.
ACCURACY = 10_000
#: Rows of wanted brackets that are read on the driver; prefix sums beyond.
FEW = 100_000


@dataclass
class Selection:
    """``values``: {(group values, column): [quantile for each prob]};
    ``slots``: the counted slots (by, feature, slot, rep, rows, sums);
    ``extra``: {(group values, column): {name: value}}."""
    values: dict
    slots: DataFrame
    extra: dict


def usable(c: Column) -> Column:
    """A column as double, NaN as null."""
    x = c.cast("double")
    return F.when(~F.isnan(x), x)


def _same(by: list[str], group: tuple) -> Column:
    cond = F.lit(True)
    for c, v in zip(by, group):
        cond = cond & F.col(c).eqNullSafe(F.lit(v))
    return cond


def _disjoint(brackets: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(brackets):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _number(v: float) -> str:
    return f"{v!r}D" if math.isfinite(v) else f"double('{v}')"


def _slot(column: str, brackets: list[tuple[float, float]]) -> Column:
    """2 j + 1 inside bracket j, 2 j below it, -1 for null and NaN."""
    x = f"cast(`{column}` as double)"
    cases = " ".join(f"WHEN {x} < {_number(lo)} THEN {2 * j} WHEN {x} <= {_number(hi)} THEN {2 * j + 1}" for j, (lo, hi) in enumerate(brackets))
    return F.expr(f"CASE WHEN {x} IS NULL OR isnan({x}) THEN -1 {cases} ELSE {2 * len(brackets)} END")


def sketch(df: DataFrame, columns: list[str], probs: list[float], by: list[str], extra: dict) -> tuple[dict, dict]:
    """({(group, column): brackets}, {(group, column): extra values}).
    ``extra``: name -> function of the column that gives an aggregate."""
    ranks = sorted({min(1.0, max(0.0, p + d * 2.0 / ACCURACY)) for p in probs for d in (-1, 1)})
    aggs = []
    for i, c in enumerate(columns):
        aggs.append(F.percentile_approx(usable(F.col(c)), ranks, ACCURACY).alias(f"q{i}"))
        aggs += [fn(F.col(c)).alias(f"x{i}_{name}") for name, fn in extra.items()]
    brackets, extras = {}, {}
    for r in (df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)).collect():   # one row a group
        group = tuple(r[c] for c in by)
        for i, c in enumerate(columns):
            at = dict(zip(ranks, r[f"q{i}"] or []))
            extras[group, c] = {name: r[f"x{i}_{name}"] for name in extra}
            brackets[group, c] = _disjoint([(at[min(1.0, max(0.0, p - 2.0 / ACCURACY))], at[min(1.0, max(0.0, p + 2.0 / ACCURACY))])
                                            for p in probs]) if at else []
    return brackets, extras


def slot_counts(df: DataFrame, columns: list[str], brackets: dict, by: list[str], sums: dict[str, Column] | None = None,
                levels: list[str] | None = None) -> DataFrame:
    """(by, feature, slot, rep, last, level, rows, sums): the rows of each slot
    of every column, per distinct value inside brackets; ``rep`` and ``last``
    are the slot's smallest and largest value.  ``levels``: columns counted by
    their own (string) values beside, with slot -1."""
    sums, levels = sums or {}, levels or []
    made = []
    for c in columns:
        x = usable(F.col(f"`{c}`"))
        slot = None
        for (group, name), found in brackets.items():
            if name == c:
                own = _slot(c, found)
                slot = own if not by else F.when(_same(by, group), own) if slot is None else slot.when(_same(by, group), own)
        slot = (F.lit(-1) if slot is None else slot).cast("int")
        made.append(F.struct(slot.alias("slot"), x.alias("x"), F.lit(None).cast("string").alias("level")).alias(c))
    made += [F.struct(F.lit(-1).cast("int").alias("slot"), F.lit(None).cast("double").alias("x"), F.col(c).cast("string").alias("level")).alias(c)
             for c in levels]
    ids = [F.col(c).alias(f"_by{i}") for i, c in enumerate(by)] + [e.alias(f"_s_{n}") for n, e in sums.items()]
    long = df.select(*ids, *made).unpivot([f"_by{i}" for i in range(len(by))] + [f"_s_{n}" for n in sums], [*columns, *levels], "feature", "v")
    inside = F.when(F.col("v.slot") % 2 == 1, F.col("v.x"))
    return (long.groupBy(*[F.col(f"_by{i}").alias(c) for i, c in enumerate(by)], "feature", F.col("v.slot").alias("slot"),
                         inside.alias("_value"), F.col("v.level").alias("level"))
            .agg(F.min("v.x").alias("rep"), F.max("v.x").alias("last"), F.count(F.lit(1)).alias("rows"),
                 *[F.sum(f"_s_{n}").alias(n) for n in sums]).drop("_value"))


def select(df: DataFrame, columns: list[str], probs: list[float], by: list[str] | None = None, extra: dict | None = None,
           sums: dict[str, Column] | None = None, levels: list[str] | None = None, local_limit: int | None = None) -> Selection:
    """Exact quantiles (linear interpolation) of many columns, per group of
    the columns ``by`` (few groups)."""
    by = by or []
    brackets, extras = sketch(df, columns, probs, by, extra or {})
    while True:
        slots = _persist(slot_counts(df, columns, brackets, by, sums, levels))
        where: dict = {}
        for r in (slots.where("slot >= 0").groupBy(*by, "feature", "slot")
                  .agg(F.sum("rows").alias("n"), F.min("rep").alias("lo"), F.max("last").alias("hi"), F.count(F.lit(1)).alias("d")).collect()):
            where.setdefault((tuple(r[c] for c in by), r["feature"]), []).append((r["slot"], r["n"], r["lo"], r["hi"], r["d"]))
        found, inside, missed, wide = {}, [], False, {}   # a few rows a quantile
        for key, rows in where.items():
            rows.sort()
            n = sum(r[1] for r in rows)
            for rank in sorted({int(f(float(n - 1) * p)) for p in probs for f in (math.floor, math.ceil)}):
                below = 0
                for slot, count, lo, hi, distinct in rows:
                    if rank < below + count:
                        break
                    below += count
                local = rank - below
                if lo == hi or local == 0:
                    found[key, rank] = lo
                elif local == count - 1:
                    found[key, rank] = hi
                elif slot % 2 == 1:
                    inside.append((*key[0], key[1], slot, local, rank))
                    wide[key, slot] = distinct
                else:   # the sketch was off: the whole gap becomes a bracket
                    brackets[key] = _disjoint([*brackets[key], (lo, hi)])
                    missed = True
        if not missed:
            break
    if inside:
        few = sum(wide.values()) <= FEW and local_limit is None
        found.update(_ranks_read(slots, by, inside) if few else _ranks_inside(slots, by, inside, local_limit))
    values = {}
    for key, rows in where.items():
        n = sum(r[1] for r in rows)
        values[key] = []
        for p in probs:
            h = float(n - 1) * p
            lo, hi, frac = found[key, math.floor(h)], found[key, math.ceil(h)], h - math.floor(h)
            values[key].append(lo if frac == 0 or lo == hi else math.fma(lo, 1.0 - frac, hi * frac))
    return Selection(values, slots, extras)


def _ranks_read(slots: DataFrame, by: list[str], inside: list[tuple]) -> dict:
    """Values at ranks within brackets of at most ``FEW`` rows."""
    numbers = sorted({w[-3] for w in inside})
    held: dict = {}
    for r in slots.where(F.col("slot").isin(numbers)).select(*by, "feature", "slot", "rep", "rows").collect():
        held.setdefault((tuple(r[c] for c in by), r["feature"], r["slot"]), []).append((r["rep"], r["rows"]))
    out = {}
    for *group, feature, slot, local, rank in inside:
        key, below = (tuple(group), feature), 0
        for value, rows in sorted(held[(*key, slot)]):
            below += rows
            if local < below:
                out[key, rank] = value
                break
    return out


def _ranks_inside(slots: DataFrame, by: list[str], inside: list[tuple], local_limit: int | None) -> dict:
    """Values at ranks within brackets, from prefix sums of the wanted ones."""
    keys = [*by, "feature", "slot"]
    types = {f.name: f.dataType.simpleString() for f in slots.schema.fields}
    wanted = slots.sparkSession.createDataFrame(inside, ", ".join([f"_{c} {types[c]}" for c in keys] + ["_local long", "_rank long"]))
    match = F.lit(True)
    for c in keys:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    slot_rows = wanted.select(*[F.col(f"_{c}") for c in keys]).distinct()
    rows = slots.select(*keys, F.col("rep").alias("value"), "rows").join(F.broadcast(slot_rows), match, "left_semi")   # rows: quantiles
    pre = prefix_sums(rows, keys, "value", ["rows"], local_limit=local_limit)
    hit = match & (F.col("_local") < F.col("cum_rows")) & (F.col("_local") >= F.col("cum_rows") - F.col("rows"))
    got = pre.join(F.broadcast(wanted), hit).select(*keys, "value", "_rank").collect()   # rows: quantiles
    return {((tuple(r[c] for c in by), r["feature"]), r["_rank"]): r["value"] for r in got}
