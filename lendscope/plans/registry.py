"""Registry of named queries (Spark) and their oracle SQL (DuckDB).

Each query reads the driver tables through ``loan_book`` and runs the
library operators over the whole table.  Modules add entries with the
``query`` decorator; ``ORACLE`` holds SQL for those that an independent
engine can reproduce exactly.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.ordered import release_cached

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def expand_round(sql: str) -> str:
    """Rewrite ``ROUNDX(expr, d)`` into NumPy-style rounding
    (scale, half-to-even, unscale), matching ``functions.numeric.np_round``."""
    out, i = [], 0
    while True:
        j = sql.find("ROUNDX(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:j])
        k, depth, comma = j + len("ROUNDX("), 1, -1
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        inner = expand_round(sql[j + len("ROUNDX("):comma])
        digits = int(sql[comma + 1:k - 1])
        scale = repr(float(10 ** digits))
        out.append(f"(round_even(({inner}) * {scale}, 0) / {scale})")
        i = k


def query(name: str, sql: str | None = None):
    def deco(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            release_cached()   # a query keeps no more than its own tables in memory
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = expand_round(sql)
        return run
    return deco
