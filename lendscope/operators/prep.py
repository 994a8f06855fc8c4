"""Projections and clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """B1: rename only the columns that are present."""
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


def encode_target(df: DataFrame, target: str = "target", good_value=None) -> DataFrame:
    """B2: make the target 0 = good, 1 = default.

    Raw {1, 2}: 1 -> 0, 2 -> 1.  Raw {0, 1}: assumed 1 = good, so flipped
    (calling it twice undoes it).  ``good_value`` overrides the rule: that
    value becomes 0 and the other becomes 1.  Any other value set (including
    a single class) raises.  The values are known from one aggregate: the
    smallest, the largest, and how many rows have neither."""
    y = F.col(target)
    low, high = F.min(y), F.max(y)
    ends = df.agg(low.alias("lo"), high.alias("hi")).first()
    vals = {v for v in (ends["lo"], ends["hi"]) if v is not None}
    if df.agg(F.sum((~y.isin(*vals)).cast("bigint")).alias("n")).first()["n"] if vals else False:
        raise ValueError(f"Unexpected target values: more than {sorted(vals)}.")
    if good_value is not None:
        if len(vals) != 2 or good_value not in vals:
            raise ValueError(f"Unexpected target values {vals} for good_value={good_value!r}.")
        (bad,) = vals - {good_value}
        expr = F.when(y == good_value, 0).when(y == bad, 1)
    elif vals == {1, 2}:
        expr = F.when(y == 1, 0).when(y == 2, 1)
    elif vals == {0, 1}:
        expr = F.when(y == 1, 0).when(y == 0, 1)
    else:
        raise ValueError(f"Unexpected target values {vals}. Expected {{0,1}} or {{1,2}}.")
    return df.withColumn(target, expr.cast("int"))


def feature_groups(df: DataFrame, numeric: list[str], categorical: list[str]) -> tuple[list[str], list[str]]:
    """The listed features present in ``df``."""
    return [c for c in numeric if c in df.columns], [c for c in categorical if c in df.columns]


def decode(df: DataFrame, col: str, labels: dict, out: str | None = None) -> DataFrame:
    """Code -> label via a literal map (bounded by the label list)."""
    m = F.create_map(*[F.lit(x) for k, v in labels.items() for x in (k, v)])
    return df.withColumn(out or f"{col}_label", F.try_element_at(m, F.col(col)))


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """A4: fill hidden applicant fields with fixed defaults."""
    return df.select(*[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c)
                       for c in df.columns],
                     *[F.lit(v).alias(k) for k, v in defaults.items() if k not in df.columns])
