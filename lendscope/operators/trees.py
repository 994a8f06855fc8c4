"""Portable tree ensembles (F8, F9, F14): a fitted forest or boosted model as
a node table and a leaf-path table, scored and explained by JVM expressions.

``TreeTable`` is the fitted state: one entry per (tree, node) with feature,
threshold or left categories, children, value and cover.  Its size is
bounded by trees x nodes, never by rows; it travels inside the plan as one
constant (a JSON literal that the optimizer folds once), so a batch, a stream
and a lost task's retry all see the same model and nothing is joined or
shuffled.

* ``score`` walks all trees of a row together, one step a level: the state is
  the array of current nodes.
* ``paths`` flattens the ensemble to (tree, leaf, feature, interval, cover
  share) rows.  A leaf's conditional expectation is a product game over the
  features on its path: feature j contributes o_j (1 if the row is inside the
  leaf's interval, else 0) when known and its cover share z_j when not.  The
  Shapley value of a product game is

      value * (o_j - z_j) * integral over t in [0, 1] of
          prod over k != j of (z_k + t (o_k - z_k))

  and the integrand is a polynomial of degree (features on the path - 1), so
  Gauss-Legendre nodes give it exactly.  ``explain`` sums these per row and
  feature: the path-dependent tree attribution without recursion.

Results for awkward rows: a null or NaN feature value goes right at numeric
splits and right at categorical ones (as Spark's own models do with
``handleInvalid="keep"``); an empty table gives an empty result; a feature
that no tree uses has attribution 0.  Scores are log-odds for boosted trees
(2 x margin), probability of class 1 for forests; expected value + sum of
attributions = score.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_SCHEMA = ("tree int, node int, feature int, threshold double, categories array<double>, "
               "left int, right int, value double, cover double")
PATH_SCHEMA = ("tree int, leaf int, value double, feature int, lo double, hi double, "
               "inside array<double>, outside array<double>, share double")
MAX_MODEL_BYTES = 64 << 20


@dataclass
class TreeTable:
    """Fitted state of an ensemble.  ``nodes``: dicts with the columns of
    ``NODE_SCHEMA`` (feature -1 in leaves, children -1 in leaves)."""

    features: list[str]
    kind: str                      # "boosted" or "forest"
    weights: list[float]           # one per tree
    nodes: list[dict] = field(default_factory=list)

    @property
    def scale(self) -> float:
        return 2.0 if self.kind == "boosted" else 1.0

    def by_tree(self) -> dict[int, dict[int, dict]]:
        out: dict[int, dict[int, dict]] = {}
        for n in self.nodes:
            out.setdefault(n["tree"], {})[n["node"]] = n
        return out

    def expected_value(self) -> float:
        total = 0.0
        for t, nodes in self.by_tree().items():
            total += self.weights[t] * sum(n["value"] * n["cover"] for n in nodes.values() if n["left"] < 0) / nodes[0]["cover"]
        return total * self.scale

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "kind": self.kind, "weights": self.weights, "nodes": self.nodes})

    @staticmethod
    def from_json(text: str) -> "TreeTable":
        return TreeTable(**json.loads(text))


def tree_table(model, features: list[str], scratch: str) -> TreeTable:
    """The node table of a fitted Spark forest or GBT classifier."""
    from .attribution import ensemble_from_model

    ens = ensemble_from_model(model, scratch)
    nodes = []
    for t, tree in enumerate(ens.trees):
        for i in range(len(tree.left)):
            cats = tree.categories[i]
            leaf = tree.left[i] < 0
            nodes.append({"tree": t, "node": i, "feature": -1 if leaf else int(tree.feature[i]),
                          "threshold": None if leaf or cats is not None else float(tree.threshold[i]),
                          "categories": sorted(float(c) for c in cats) if cats is not None else None,
                          "left": int(tree.left[i]), "right": int(tree.right[i]),
                          "value": float(tree.value[i]), "cover": float(tree.cover[i])})
    return TreeTable(list(features), "boosted" if ens.scale == 2.0 else "forest", [float(w) for w in ens.weights], nodes)


def node_frame(spark: SparkSession, table: TreeTable) -> DataFrame:
    """The node table as a DataFrame (to store it, or to join it in SQL)."""
    cols = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(n[c] for c in cols) for n in table.nodes], NODE_SCHEMA)


def paths(table: TreeTable) -> list[dict]:
    """The leaf-path table: one entry per (tree, leaf, feature on its path)
    with the interval (lo, hi], the category sets and the cover share, all
    steps of one feature merged.  A tree of one leaf has no path."""
    out = []
    for t, nodes in sorted(table.by_tree().items()):
        todo = [(0, {})]
        while todo:
            i, path = todo.pop()
            n = nodes[i]
            if n["left"] < 0:
                out += [{"tree": t, "leaf": i, "value": n["value"], **slot} for slot in path.values()]
                continue
            for child, is_left in ((n["right"], False), (n["left"], True)):
                f = n["feature"]
                s = dict(path.get(f, {"feature": f, "lo": None, "hi": None, "inside": None, "outside": None, "share": 1.0}))
                s["share"] = s["share"] * nodes[child]["cover"] / n["cover"]
                cut, cats = n["threshold"], n["categories"]
                if cats is not None and is_left:
                    s["inside"] = sorted(set(cats) if s["inside"] is None else set(cats) & set(s["inside"]))
                elif cats is not None:
                    s["outside"] = sorted(set(cats) | set(s["outside"] or []))
                elif is_left:
                    s["hi"] = cut if s["hi"] is None else min(cut, s["hi"])
                else:
                    s["lo"] = cut if s["lo"] is None else max(cut, s["lo"])
                todo.append((child, {**path, f: s}))
    return out


def path_frame(spark: SparkSession, table: TreeTable) -> DataFrame:
    cols = [c.split()[0] for c in PATH_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(p[c] for c in cols) for p in paths(table)], PATH_SCHEMA)


def _constant(value, schema: str) -> Column:
    """A nested value as one constant of the plan, folded by the optimizer."""
    text = json.dumps(value)
    if len(text) > MAX_MODEL_BYTES:
        raise ValueError(f"model of {len(text)} bytes is over {MAX_MODEL_BYTES}")
    return F.from_json(F.lit(text), schema)


def _values(features: list[str]) -> Column:
    """The row's feature values; nulls as NaN, as an assembled vector has."""
    return F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features])


def _bind(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, evaluated once.  A column of
    an earlier projection would be put back into the lambdas by the optimizer
    and evaluated at each of their steps."""
    return f"transform(array({value}), {name} -> {body})[0]"


# SQL of "x goes left at node n"; NaN is above every number in Spark's order.
_GOES_LEFT = "CASE WHEN n.categories IS NULL THEN xs[n.feature] <= n.threshold ELSE array_contains(n.categories, xs[n.feature]) END"


def _depth(table: TreeTable) -> int:
    deepest = 0
    for nodes in table.by_tree().values():
        level, d = [0], 0
        while level:
            level = [c for i in level for c in (nodes[i]["left"], nodes[i]["right"]) if c >= 0]
            d += 1
        deepest = max(deepest, d)
    return deepest


def score(df: DataFrame, table: TreeTable, out: str = "pd", raw: str | None = None) -> DataFrame:
    """Add the PD (and with ``raw`` the score that attributions add up to).
    One narrow stage; works on batches and streams."""
    at = {(n["tree"], n["node"]): i for i, n in enumerate(table.nodes)}
    packed = [{"feature": n["feature"], "threshold": n["threshold"], "categories": n["categories"],
               "left": at.get((n["tree"], n["left"]), -1), "right": at.get((n["tree"], n["right"]), -1),
               "value": n["value"] * table.weights[n["tree"]]} for n in table.nodes]
    roots = [at[t, 0] for t in sorted(table.by_tree())]
    nodes = _constant(packed, "array<struct<feature:int,threshold:double,categories:array<double>,left:int,right:int,value:double>>")
    step = (f"transform(slice(__nodes, p + 1, 1), n -> CASE WHEN n.left < 0 THEN p WHEN {_GOES_LEFT} "
            "THEN n.left ELSE n.right END)[0]")
    leaves = f"aggregate(sequence(1, {_depth(table)}), __roots, (ps, level) -> transform(ps, p -> {step}))"
    total = _bind("xs", "__x", f"aggregate({leaves}, 0D, (a, p) -> a + __nodes[p].value) * {table.scale!r}D")
    name = raw or "__raw"
    scored = (df.withColumns({"__x": _values(table.features), "__nodes": nodes, "__roots": _constant(roots, "array<int>")})
              .withColumn(name, F.expr(total)))
    pd_col = 1 / (1 + F.exp(-F.col(name))) if table.kind == "boosted" else F.col(name)
    scored = scored.withColumn(out, pd_col).drop("__x", "__nodes", "__roots")
    return scored if raw else scored.drop("__raw")


def _leaf_frame(spark: SparkSession, table: TreeTable) -> tuple[DataFrame, int]:
    """One row per leaf with its path features side by side (absent slots:
    feature -1, share 1), and the longest path."""
    leaves: dict = {}
    for p in paths(table):
        leaves.setdefault((p["tree"], p["leaf"]), []).append(p)
    width = max((len(v) for v in leaves.values()), default=1)
    empty = {"feature": -1, "lo": None, "hi": None, "inside": None, "outside": None, "share": 1.0}
    kinds = {"feature": "int", "lo": "double", "hi": "double", "inside": "array<double>", "outside": "array<double>", "share": "double"}
    rows = []
    for (t, _), slots in sorted(leaves.items()):
        row = [slots[0]["value"] * table.weights[t] * table.scale]
        for s in slots + [empty] * (width - len(slots)):
            row += [s[c] for c in kinds]
        rows.append(tuple(row))
    if len(json.dumps(rows)) > MAX_MODEL_BYTES:
        raise ValueError(f"leaf-path table is over {MAX_MODEL_BYTES} bytes")
    schema = "__w double" + "".join(f", __{c}{i} {k}" for i in range(width) for c, k in kinds.items())
    return spark.createDataFrame(rows, schema), width


def explain(df: DataFrame, table: TreeTable, key: str) -> DataFrame:
    """Long output (key, feature, value, shap): the attribution of every
    feature of every row.

    The slim rows (key, features) are grouped once; the leaf-path table, whose
    size is checked, is broadcast to them, and the sums over leaves use the
    grouping that is there, so nothing is shuffled a second time.  Equal rows
    are explained once and come back as often as they occurred."""
    k = len(table.features)
    leaves, width = _leaf_frame(df.sparkSession, table)
    slots = range(width)
    t, w = np.polynomial.legendre.leggauss((width + 1) // 2)   # exact to degree width - 1
    t, w = (t + 1) / 2, w / 2
    cols = [f"__x{j}" for j in range(k)]
    values = _values(table.features)
    # the work is rows x leaves, not bytes: a stated number of partitions, which adaptive execution doesn't merge
    spark = df.sparkSession
    parts_wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = (df.select(F.col(key), *[F.get(values, F.lit(j)).alias(c) for j, c in enumerate(cols)])
            .repartition(parts_wanted, key, *cols).groupBy(key, *cols).agg(F.count(F.lit(1)).alias("__copies")).withColumn("__x", F.array(*cols)))
    inside = [f"""CASE WHEN __feature{i} < 0 OR (
        (__lo{i} IS NULL OR get(__x, __feature{i}) > __lo{i}) AND (__hi{i} IS NULL OR get(__x, __feature{i}) <= __hi{i})
        AND (__inside{i} IS NULL OR array_contains(__inside{i}, get(__x, __feature{i})))
        AND (__outside{i} IS NULL OR NOT array_contains(__outside{i}, get(__x, __feature{i})))) THEN 1D ELSE 0D END AS __o{i}"""
              for i in slots]

    def at_node(i, g):
        return f"(__share{i} + {float(t[g])!r}D * (__o{i} - __share{i}))"
    prods = [" * ".join(at_node(i, g) for i in slots) + f" AS __p{g}" for g in range(len(t))]
    parts = [f"CASE WHEN __feature{i} < 0 OR __o{i} = __share{i} THEN 0D ELSE __w * (__o{i} - __share{i}) * ("
             + " + ".join(f"{float(w[g])!r}D * __p{g} / {at_node(i, g)}" for g in range(len(t))) + f") END AS __phi{i}" for i in slots]
    sums = [F.expr("sum(" + " + ".join(f"CASE WHEN __feature{i} = {j} THEN __phi{i} ELSE 0D END" for i in slots) + ")").alias(f"__s{j}")
            for j in range(k)]
    total = (rows.join(F.broadcast(leaves), how="left")
             .selectExpr("*", *inside).selectExpr("*", *prods).selectExpr("*", *parts)
             .groupBy(key, *cols).agg(F.first("__copies").alias("__copies"), *sums))
    long = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(c).alias("value"), F.coalesce(F.col(f"__s{j}"), F.lit(0.0)).alias("shap"))
                     for j, (f, c) in enumerate(zip(table.features, cols))])
    each = F.explode(F.flatten(F.array_repeat(long, F.col("__copies").cast("int"))))
    return total.select(key, each.alias("__e")).select(key, "__e.feature", "__e.value", "__e.shap")


def global_importance(expl: DataFrame) -> DataFrame:
    """mean |attribution| per feature, strongest first."""
    return expl.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap")).orderBy(
        F.desc("mean_abs_shap"), "feature")
