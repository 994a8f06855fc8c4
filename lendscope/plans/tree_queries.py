"""F8, F9, F14 with a stored ensemble: the book scored and explained by a
portable node table, checked against SQL that walks the same table.

``book_trees.json`` holds two fitted ensembles (``scripts/fit_book_trees.py``),
as any scoring service would load them.  The SQL descends by a recursive CTE
over the nodes, and takes the attributions from the definition of the Shapley
value (all subsets of the features on a leaf's path), not from the operator's
integral."""

from __future__ import annotations

import json
import math
import os

from pyspark.sql import functions as F

from ..functions.numeric import np_round
from ..operators import trees
from ..sources.loan_book import loan_book
from .registry import query
from .sql_parts import with_loan_book

MODEL_FILE = os.path.join(os.path.dirname(os.path.abspath(__file__)), "book_trees.json")
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM"]   # their code is the place, all others 3
FEATURES = ["credit_amount", "acct_balance", "n_lines", "total_qty", "priority_code"]


def tree_features(book):
    code = F.lit(float(len(PRIORITIES)))
    for i, p in reversed(list(enumerate(PRIORITIES))):
        code = F.when(F.col("priority") == p, F.lit(float(i))).otherwise(code)
    return book.withColumn("priority_code", code)


def stored(kind: str) -> trees.TreeTable:
    with open(MODEL_FILE) as f:
        return trees.TreeTable(**json.load(f)[kind])


def _node_ctes(table: trees.TreeTable) -> str:
    """CTEs ``nodes`` and ``x(loan_id, feature, v)``."""
    def lit(v):
        return "NULL" if v is None else f"{v!r}"
    rows = ", ".join(f"({n['tree']}, {n['node']}, {n['feature']}, CAST({lit(n['threshold'])} AS DOUBLE), {n['left']}, {n['right']}, "
                     f"CAST({lit(n['value'])} AS DOUBLE), CAST({lit(n['cover'])} AS DOUBLE), "
                     f"CAST({lit(table.weights[n['tree']] * table.scale)} AS DOUBLE))" for n in table.nodes)
    code = "CASE " + " ".join(f"WHEN priority = '{p}' THEN {i}" for i, p in enumerate(PRIORITIES)) + f" ELSE {len(PRIORITIES)} END"
    cols = [f if f != "priority_code" else code for f in FEATURES]
    long = " UNION ALL ".join(f"SELECT loan_id, {i} AS feature, CAST({c} AS DOUBLE) AS v FROM loan_book" for i, c in enumerate(cols))
    return f"""
, nodes(tree, node, feature, threshold, lc, rc, val, cover, w) AS (VALUES {rows})
, x AS ({long})"""


def _pd_sql(kind: str) -> str:
    prob = "1 / (1 + exp(-s))" if kind == "boosted" else "s"
    return with_loan_book(_node_ctes(stored(kind)) + f"""
, walk AS (
  SELECT b.loan_id, n.tree, n.node, n.feature, n.threshold, n.lc, n.rc, n.val * n.w AS v
  FROM loan_book b CROSS JOIN nodes n WHERE n.node = 0
  UNION ALL
  SELECT k.loan_id, n.tree, n.node, n.feature, n.threshold, n.lc, n.rc, n.val * n.w
  FROM walk k JOIN x ON x.loan_id = k.loan_id AND x.feature = k.feature
  JOIN nodes n ON n.tree = k.tree AND n.node = CASE WHEN x.v <= k.threshold THEN k.lc ELSE k.rc END
  WHERE k.lc >= 0)
, total AS (SELECT loan_id, SUM(v) AS s FROM walk WHERE lc < 0 GROUP BY loan_id)
SELECT loan_id, ROUNDX({prob}, 9) AS pd FROM total""").replace("WITH ", "WITH RECURSIVE ", 1)


def _shap_sql(kind: str) -> str:
    """Shapley values by their definition: every subset of a leaf's features
    (bits of a mask over the path), weight |S|! (m - |S| - 1)! / m!."""
    facts = [math.factorial(i) for i in range(8)]
    names = "CASE s.feature " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FEATURES)) + " END"
    return with_loan_book(_node_ctes(stored(kind)) + f"""
, steps AS (
  SELECT tree, node AS leaf, node AS cur, val * w AS v, CAST(-1 AS INTEGER) AS feature, CAST(NULL AS DOUBLE) AS lo,
         CAST(NULL AS DOUBLE) AS hi, CAST(1 AS DOUBLE) AS share
  FROM nodes WHERE lc < 0
  UNION ALL
  SELECT s.tree, s.leaf, p.node, s.v, p.feature, CASE WHEN p.rc = s.cur THEN p.threshold END,
         CASE WHEN p.lc = s.cur THEN p.threshold END, c.cover / p.cover
  FROM steps s JOIN nodes p ON p.tree = s.tree AND (p.lc = s.cur OR p.rc = s.cur)
  JOIN nodes c ON c.tree = s.tree AND c.node = s.cur)
, slot0 AS (
  SELECT tree, leaf, feature, any_value(v) AS v, MAX(lo) AS lo, MIN(hi) AS hi, product(share) AS z
  FROM steps WHERE feature >= 0 GROUP BY tree, leaf, feature)
, slot AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY tree, leaf ORDER BY feature) - 1 AS INTEGER) AS j,
         CAST(COUNT(*) OVER (PARTITION BY tree, leaf) AS INTEGER) AS m FROM slot0)
, inside AS (
  SELECT x.loan_id, s.tree, s.leaf, s.feature, s.v, s.j, s.m, s.z,
         CASE WHEN (s.lo IS NULL OR x.v > s.lo) AND (s.hi IS NULL OR x.v <= s.hi) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS o
  FROM x JOIN slot s ON s.feature = x.feature)
, masks AS (SELECT m, CAST(mask AS INTEGER) AS mask
            FROM (SELECT DISTINCT m FROM slot), range(0, 16) r(mask) WHERE mask < (1 << m))
, worth AS (
  SELECT i.loan_id, i.tree, i.leaf, k.mask, any_value(i.v) * product(CASE WHEN (k.mask >> i.j) & 1 = 1 THEN i.o ELSE i.z END) AS f
  FROM inside i JOIN masks k ON k.m = i.m GROUP BY i.loan_id, i.tree, i.leaf, k.mask)
, parts AS (
  SELECT a.loan_id, s.feature,
         (b.f - a.f) * ({facts}[bit_count(a.mask) + 1] * {facts}[s.m - bit_count(a.mask)])::DOUBLE / {facts}[s.m + 1] AS part
  FROM slot s JOIN worth a ON a.tree = s.tree AND a.leaf = s.leaf AND (a.mask >> s.j) & 1 = 0
  JOIN worth b ON b.loan_id = a.loan_id AND b.tree = a.tree AND b.leaf = a.leaf AND b.mask = a.mask + (1 << s.j))
, phi AS (SELECT loan_id, feature, SUM(part) AS shap FROM parts GROUP BY loan_id, feature)
SELECT s.loan_id, {names} AS feature, s.v AS value, ROUNDX(COALESCE(p.shap, 0), 9) + 0 AS shap
FROM x s LEFT JOIN phi p ON p.loan_id = s.loan_id AND p.feature = s.feature""").replace("WITH ", "WITH RECURSIVE ", 1)


def _scored(spark, sf_dir, kind):
    book = tree_features(loan_book(spark, sf_dir)).select("loan_id", *FEATURES)
    return trees.score(book, stored(kind), "pd").select("loan_id", np_round("pd", 9).alias("pd"))


@query("forest_table_pd", _pd_sql("forest"))
def forest_table_pd_q(spark, sf_dir):
    """F8: PD of every loan by a stored random forest."""
    return _scored(spark, sf_dir, "forest")


@query("boosted_table_pd", _pd_sql("boosted"))
def boosted_table_pd_q(spark, sf_dir):
    """PD of every loan by stored boosted trees."""
    return _scored(spark, sf_dir, "boosted")


@query("tree_path_attribution", _shap_sql("boosted"))
def tree_path_attribution_q(spark, sf_dir):
    """attribution of every loan and feature (log-odds) by the leaf-path
    table of stored boosted trees."""
    book = tree_features(loan_book(spark, sf_dir))
    out = trees.explain(book, stored("boosted"), "loan_id")
    return out.select("loan_id", "feature", "value", (np_round("shap", 9) + 0).alias("shap"))
