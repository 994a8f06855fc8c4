"""Mixing sources to target weights, in DataFrame functions only.

Documents are leaves' members in a tree of levels (here domain, language,
source).  A token budget goes from the root down: at each node it is shared
among the children by their weights, no child getting more than its subtree
can give (supply times ``max_epochs``); what a short child can't take goes to
its siblings by their weights, and only what no sibling can take is left to
the ancestors, whose other children have got it by the same rule one level
up (a subtree's capacity is known before its parent shares).  Within a leaf
the budget is a prefix of tokens of its seeded epochs: every epoch is the
leaf's rows in the order of md5(seed|epoch|doc_id) and, for rows that share an
id, md5(text); one epoch after the other, and the last row is taken in part
(``tokens_taken``).

Shares are exact: a child whose share reaches its capacity gets the capacity,
the others floor(rest * weight / weights of the others), in whole numbers.

Plan: one slim table (ids and token counts, no text) is written once; the
tree is an aggregate with one row per leaf; a leaf's cut is found from 4,096
partial sums over the leading hex digits of the order key, then inside the
one bucket that holds it, then in the same two steps among the texts of the
one id, so neither a leaf nor an id (null, say) with a third of all rows is
ever sorted or gathered; the cuts (one row per leaf) are joined to the
documents.  Equal texts under one id are counted, not listed; which of them
are taken at the cut is decided by their number among the cut's rows, from
counts per input partition.

Defined results: texts that are null or have no words give no tokens and are
not selected; null level values form a node of their own; every row is a
document of its own, whatever its id, and a leaf never gives more than its
budget; a null doc_id counts as the empty text in the order key; weights not named are ``1``, and a node of weight 0
or less gives nothing.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import materialize

WORD = r"[^ \t\n\x0B\f\r]+"
BUCKET_DIGITS = 3


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), epoch.cast("string"), F.lit("|"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _same(a: DataFrame, b: DataFrame, cols: list[str]):
    cond = F.lit(True)
    for c in cols:
        cond = cond & a[c].eqNullSafe(b[c])
    return cond


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    w = F.lit(1)
    for value, n in (weights.get(level) or {}).items():
        w = F.when(F.col(level) == value, F.lit(int(n))).otherwise(w)
    return w.cast("decimal(12,0)")


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], budget: Column,
            max_epochs: int) -> DataFrame:
    """``leaves`` (levels, supply) with ``alloc``, each leaf's token budget.
    ``budget`` is an expression over the one row (total supply)."""
    dec = "decimal(24,0)"
    node = leaves.withColumn("cap", (F.col("supply") * max_epochs).cast(dec))
    for level in levels:
        node = node.withColumn("cap", F.when(_weight(level, weights) > 0, F.col("cap")).otherwise(F.lit(0).cast(dec)))
    caps = [node]  # caps[i]: nodes of depth len(levels) - i
    for depth in range(len(levels) - 1, 0, -1):
        caps.append(caps[-1].groupBy(*levels[:depth]).agg(F.sum("cap").cast(dec).alias("cap")))
    total = node.agg(F.coalesce(F.sum("supply"), F.lit(0)).cast("long").alias("supply"))
    root = total.select(budget.cast(dec).alias("b")).first()["b"]  # one number
    parent, above = None, []
    for i, level in enumerate(levels):
        child = caps[len(levels) - 1 - i].withColumn("w", F.greatest(_weight(level, weights), F.lit(1).cast("decimal(12,0)")))
        child = child.withColumn("b", F.lit(root).cast(dec)) if parent is None else child.join(
            parent.withColumnsRenamed({c: f"__{c}" for c in above}),
            [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in above]).drop(*[f"__{c}" for c in above])
        order = W.partitionBy(*above).orderBy(F.col("cap").cast("double") / F.col("w").cast("double"), level)
        before = order.rowsBetween(W.unboundedPreceding, -1)
        every = W.partitionBy(*above)
        zero = F.lit(0).cast(dec)
        child = (child.withColumn("s", F.coalesce(F.sum("cap").over(before).cast(dec), zero))
                 .withColumn("v", F.sum("w").over(every).cast(dec) - F.coalesce(F.sum("w").over(before).cast(dec), zero))
                 .withColumn("full", F.col("w") * (F.col("b") - F.col("s")) >= F.col("cap") * F.col("v")))
        child = (child.withColumn("fs", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every).cast(dec), zero))
                 .withColumn("fw", F.sum(F.when(~F.col("full"), F.col("w"))).over(every).cast(dec)))
        alloc = F.when(F.col("full"), F.col("cap")).otherwise(
            F.greatest(F.expr("((b - fs) * w) div fw").cast(dec), zero))
        above = levels[:i + 1]
        keep = [F.col(c) for c in above] + ([F.col("supply")] if i == len(levels) - 1 else [])
        parent = child.select(*keep, alloc.cast(dec).alias("b"))
    return parent.select(*levels, "supply", F.col("b").cast("long").alias("alloc"))


def plan(docs: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], budget: Column, max_epochs: int,
         seed: int) -> DataFrame:
    """One row per leaf: levels, supply, alloc, full (whole epochs), rest,
    cut (order key of the last document), cut_left (its tokens)."""
    spark = docs.sparkSession
    slim = materialize(spark, docs.select("doc_id", *levels, token_count(F.col("text")).alias("n"), F.md5(F.col("text").cast("binary")).alias("h"))
                       .where("n > 0").groupBy("doc_id", *levels, "h").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))
                       .withColumn("n_tokens", F.col("n") * F.col("copies")), "mix-slim")
    leaves = slim.groupBy(*levels).agg(F.sum("n_tokens").alias("supply"))
    leaf = budgets(leaves, levels, weights, budget, max_epochs)
    leaf = materialize(spark, leaf.withColumn("full", F.expr("cast(alloc div supply as int)"))
                       .withColumn("rest", F.expr("alloc % supply")), "mix-leaves")
    right = leaf.where("rest > 0").select(*[F.col(c).alias(f"__{c}") for c in levels], "full", "rest")
    keyed = slim.join(right, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in levels]).drop(*[f"__{c}" for c in levels])
    keyed = keyed.withColumn("key", _key(seed, F.col("full"), F.col("doc_id"))).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    keyed = materialize(spark, keyed.select(*levels, "rest", F.lit(0).cast("long").alias("before"), "key", "bucket", "h",
                                            F.substring("h", 1, BUCKET_DIGITS).alias("part"), "n", "n_tokens"), "mix-keys")
    for by in ("bucket", "key", "part"):
        keyed = _inside(keyed, levels, by)
    last = (_cut(keyed, levels, "h", F.max("n").alias("n"), F.max("key").alias("key"))
            .select(*[F.col(f"__{c}") for c in levels], F.col("key").alias("cut"), F.col("__h").alias("cut_text"), F.col("n").alias("cut_n"),
                    (F.col("rest") - F.col("before")).alias("cut_left")))
    out = (leaf.join(last, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in levels], "left").drop(*[f"__{c}" for c in levels]))
    return materialize(spark, out, "mix-plan")


def _cut(keyed: DataFrame, levels: list[str], by: str, *more: Column) -> DataFrame:
    """For each leaf the value of ``by`` at which the running sum of tokens
    reaches ``rest``, with the tokens before it; columns named with ``__``."""
    sums = keyed.groupBy(*levels, by).agg(F.sum("n_tokens").alias("t"), F.max("rest").alias("rest"), F.max("before").alias("before"), *more)
    run = W.partitionBy(*levels).orderBy(by).rowsBetween(W.unboundedPreceding, 0)
    got = sums.withColumn("upto", F.col("before") + F.sum("t").over(run)).where("upto >= rest and upto - t < rest")
    return got.withColumn("before", F.col("upto") - F.col("t")).withColumnsRenamed({c: f"__{c}" for c in [*levels, by]})


def _inside(keyed: DataFrame, levels: list[str], by: str) -> DataFrame:
    """The rows at the cut's value of ``by``, with the tokens before them."""
    at = _cut(keyed, levels, by).select(*[F.col(f"__{c}") for c in levels], F.col(f"__{by}").alias("__at"),
                                        F.col("before").alias("__before"))
    cond = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in levels] + [F.col(by) == F.col("__at")]
    return keyed.join(at, cond).withColumn("before", F.col("__before")).select(*keyed.columns)


def mix(docs: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], budget: Column, max_epochs: int = 1,
        seed: int = 17) -> DataFrame:
    """The selected rows of ``docs`` with epoch, n_tokens and tokens_taken
    (clashing columns of these names are replaced).

    ``budget`` is a Column over ``supply``, the tokens of all documents."""
    drop = {"epoch", "n_tokens", "tokens_taken"}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in drop])
    spark = docs.sparkSession
    cuts = plan(docs, levels, weights, budget, max_epochs, seed).select(
        *[F.col(c).alias(f"__{c}") for c in levels], *[F.col(c).alias(f"__{c}") for c in ("full", "cut", "cut_text", "cut_n", "cut_left")])
    names = docs.columns
    rows = (docs.join(cuts, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in levels])
            .withColumn("__key", _key(seed, F.col("__full"), F.col("doc_id"))).withColumn("__h", F.md5(F.col("text").cast("binary"))))
    at_cut = (F.col("__key") == F.col("__cut")) & (F.col("__h") == F.col("__cut_text"))
    before = F.coalesce((F.col("__key") < F.col("__cut")) | ((F.col("__key") == F.col("__cut")) & (F.col("__h") < F.col("__cut_text"))), F.lit(False))
    out = [F.col(f"`{c}`") for c in names]
    counted = rows.withColumn("n_tokens", token_count(F.col("text"))).where("n_tokens > 0")
    whole = (counted.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("__full"))))
             .where((F.col("epoch") < F.col("__full")) | before)
             .select(*out, "epoch", "n_tokens", F.col("n_tokens").alias("tokens_taken")))
    # the rows at a leaf's cut: one, or the equal texts of one id
    cut = materialize(spark, counted.where(at_cut).select(*[F.col(f"`{c}`") for c in {*names, "__full", "__cut_left", "n_tokens"}])
                      .withColumn("__row", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__row", 33)), "mix-cut")
    sizes = cut.groupBy(*levels, "__part").agg(F.count(F.lit(1)).alias("__m"))
    ahead = sizes.withColumn("__ahead", F.coalesce(F.sum("__m").over(W.partitionBy(*levels).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ahead = ahead.select(*[F.col(c).alias(f"__{c}") for c in levels], F.col("__part").alias("__p"), "__ahead")
    number = F.col("__ahead") + F.row_number().over(W.partitionBy(*levels, "__part").orderBy("__row")) - 1
    taken = F.greatest(F.least(F.col("n_tokens"), F.col("__cut_left") - F.col("__number") * F.col("n_tokens")), F.lit(0))
    last = (cut.join(ahead, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in levels] + [F.col("__part") == F.col("__p")])
            .withColumn("__number", number).withColumn("tokens_taken", taken.cast("long")).where("tokens_taken > 0")
            .select(*out, F.col("__full").alias("epoch"), "n_tokens", "tokens_taken"))
    return whole.unionByName(last)


#: Weights of the registered query.
LEVELS = ["domain", "lang", "source"]
WEIGHTS = {"domain": {"web": 5, "books": 3, "forum": 2, "other": 1}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 1}}


def domain_of(source: Column) -> Column:
    """A domain for each source: its number modulo 3 chooses web, books or
    forum; without a number (or null) it is other."""
    n = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1).try_cast("int") % 3
    return F.when(n == 0, "web").when(n == 1, "books").when(n == 2, "forum").otherwise("other")


def oracle_sql(fraction_percent: int, max_epochs: int, seed: int) -> str:
    def weight(level):
        cases = " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in WEIGHTS.get(level, {}).items())
        return f"CASE {cases} ELSE 1 END" if cases else "1"

    def share(name, child, parent, keys, level):
        part = f"PARTITION BY {', '.join(keys)}" if keys else ""
        cond = " AND ".join(f"c.{k} IS NOT DISTINCT FROM p.{k}" for k in keys) or "true"
        cols = ", ".join([*keys, level])
        return f"""
{name}1 AS (SELECT c.*, p.b, CAST({weight(level)} AS HUGEINT) AS w FROM {child} c JOIN {parent} p ON {cond}),
{name}2 AS (SELECT *, COALESCE(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s,
  sum(w) OVER ({part}) - COALESCE(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS v
  FROM {name}1 WINDOW o AS ({part} ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), {level} NULLS FIRST)),
{name}3 AS (SELECT *, w * (b - s) >= cap * v AS fl FROM {name}2),
{name}4 AS (SELECT *, COALESCE(sum(CASE WHEN fl THEN cap END) OVER ({part}), 0) AS fs, sum(CASE WHEN NOT fl THEN w END) OVER ({part}) AS fw FROM {name}3),
{name} AS (SELECT {cols}, CASE WHEN fl THEN cap ELSE greatest(((b - fs) * w) // fw, 0) END AS b FROM {name}4)"""

    word = r"[^ \t\n\x0B\f\r]+"
    return f"""
WITH d AS (
  SELECT doc_id, lang, source, md5(text) AS h, len(regexp_extract_all(text, '{word}')) AS n_tokens,
    CASE TRY_CAST(regexp_extract(COALESCE(source, ''), '([0-9]{{1,9}})$', 1) AS INTEGER) % 3
      WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'forum' ELSE 'other' END AS domain
  FROM documents),
t AS (SELECT * FROM d WHERE n_tokens > 0),
c3 AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS HUGEINT) AS supply, CAST(sum(n_tokens) * {max_epochs} AS HUGEINT) AS cap FROM t GROUP BY ALL),
c2 AS (SELECT domain, lang, CAST(sum(cap) AS HUGEINT) AS cap FROM c3 GROUP BY ALL),
c1 AS (SELECT domain, CAST(sum(cap) AS HUGEINT) AS cap FROM c2 GROUP BY ALL),
root AS (SELECT CAST((COALESCE(sum(supply), 0) * {fraction_percent}) // 100 AS HUGEINT) AS b FROM c3),
{share('a1', 'c1', 'root', [], 'domain')},
{share('a2', 'c2', 'a1', ['domain'], 'lang')},
{share('a3', 'c3', 'a2', ['domain', 'lang'], 'source')},
leaf AS (SELECT a3.*, c3.supply, CAST(b // supply AS INTEGER) AS fl, b % supply AS rest FROM a3 JOIN c3
  ON a3.domain IS NOT DISTINCT FROM c3.domain AND a3.lang IS NOT DISTINCT FROM c3.lang AND a3.source IS NOT DISTINCT FROM c3.source),
k AS (SELECT t.*, leaf.fl, leaf.rest, md5('{seed}|' || fl || '|' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS key FROM t JOIN leaf
  ON t.domain IS NOT DISTINCT FROM leaf.domain AND t.lang IS NOT DISTINCT FROM leaf.lang AND t.source IS NOT DISTINCT FROM leaf.source),
r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, h ROWS UNBOUNDED PRECEDING) AS upto FROM k),
x AS (SELECT *, unnest(range(0, fl + 1)) AS epoch FROM r)
SELECT doc_id, domain, lang, source, CAST(epoch AS INTEGER) AS epoch, CAST(n_tokens AS BIGINT) AS n_tokens,
  CAST(CASE WHEN epoch < fl THEN n_tokens ELSE least(n_tokens, rest - upto + n_tokens) END AS BIGINT) AS tokens_taken
FROM x WHERE epoch < fl OR upto - n_tokens < rest"""
