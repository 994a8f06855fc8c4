"""The ``loan_book`` view: one row per order, shaped like a loan table.

Defined identically in Spark (``loan_book``) and in ANSI SQL for DuckDB
(``LOAN_BOOK_SQL``), so every registered query can be checked against an
independent engine.  The label is a deterministic function of the key
(md5) and a few columns, computed with integer arithmetic only.

Fixed values of the view definition (per-mille PD rule):
    base 120
    priority: '1-URGENT' 260, '2-HIGH' 140, '3-MEDIUM' 60, otherwise 0
    balance:  < 0 -> 220, < 2500 -> 80, otherwise 0
    amount:   > 400000 -> 200, > 200000 -> 60, otherwise 0
    u = first 8 hex digits of md5('d-' || loan_id) as integer, mod 1000
    target = 1 if u < pm
    pd_fine = pm/1000 + (hex digits 9-16 as integer mod 1000000) / 1e9

Plan at scale: lineitem is pre-aggregated per order (partial + final hash
aggregate keyed by l_orderkey), joined to orders on the same key (both
sides hash-partitioned on the order key, no extra exchange on the
aggregate side), then customer by key; nation/region are TPC-H fixed-size
dimensions that the optimizer broadcasts under its size threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

NUMERIC_FEATURES = ["credit_amount", "acct_balance", "n_lines", "total_qty"]
CATEGORICAL_FEATURES = ["priority", "segment", "region"]
ALL_FEATURES = NUMERIC_FEATURES + CATEGORICAL_FEATURES


def _hex_int(col, start: int, length: int = 8):
    return F.conv(F.substring(col, start, length), 16, 10).cast("bigint")


def loan_book(spark: SparkSession, sf_dir: str, materialize: bool = False) -> DataFrame:
    """The view; ``materialize=True`` is for queries that read it more than
    once: it is written once per session and input folder as a parquet table
    in the session's checkpoint folder (shared storage on a cluster), so
    later passes get column pruning and filter pushdown, nothing upstream is
    recomputed, and a lost executor does not send work back to the lineitem
    aggregation.  Queries of one pass read a copy that is there already but
    never write one.  ``release_books`` deletes the copies."""
    made = _COPIES.get((spark.sparkContext.applicationId, sf_dir))
    if made is not None:
        return spark.read.parquet(made)
    book = _loan_book(spark, sf_dir)
    if not materialize:
        return book
    from ..session import scratch_path

    root = scratch_path(spark, "loan-book")
    # A small orders table (fewer file splits than cores) gives a book in a
    # handful of partitions; spread it on write so per-row CPU work runs in
    # parallel.  Counting file splits runs no job.  Large inputs already
    # have many partitions and are written as they are (no extra shuffle).
    par = spark.sparkContext.defaultParallelism
    if read_table(spark, sf_dir, "orders", ["o_orderkey"]).rdd.getNumPartitions() < par:
        book = book.repartition(par, "loan_id")
    book.write.mode("overwrite").parquet(root)
    _COPIES[(spark.sparkContext.applicationId, sf_dir)] = root
    return spark.read.parquet(root)


_COPIES: dict[tuple[str, str], str] = {}


def release_books(spark: SparkSession) -> None:
    """Delete this session's copies of the view."""
    app = spark.sparkContext.applicationId
    for key in [k for k in _COPIES if k[0] == app]:
        path = spark._jvm.org.apache.hadoop.fs.Path(_COPIES.pop(key))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _loan_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders",
                        ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"])
    customer = read_table(spark, sf_dir, "customer",
                          ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    region = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    lines = (read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_quantity"])
             .groupBy("l_orderkey")
             .agg(F.count(F.lit(1)).alias("li_n"), F.sum("l_quantity").alias("li_qty")))
    geo = nation.join(region, nation.n_regionkey == region.r_regionkey, "left")

    book = (orders
            .join(lines, orders.o_orderkey == lines.l_orderkey, "left")
            .join(customer, orders.o_custkey == customer.c_custkey, "left")
            .join(geo, F.col("c_nationkey") == F.col("n_nationkey"), "left"))

    pm = (F.lit(120)
          + F.when(F.col("o_orderpriority") == "1-URGENT", 260)
             .when(F.col("o_orderpriority") == "2-HIGH", 140)
             .when(F.col("o_orderpriority") == "3-MEDIUM", 60).otherwise(0)
          + F.when(F.col("c_acctbal") < 0, 220)
             .when(F.col("c_acctbal") < 2500, 80).otherwise(0)
          + F.when(F.col("o_totalprice") > 400000, 200)
             .when(F.col("o_totalprice") > 200000, 60).otherwise(0)).cast("bigint")
    digest = F.md5(F.concat(F.lit("d-"), F.col("o_orderkey").cast("string")))

    out = book.select(
        F.col("o_orderkey").cast("bigint").alias("loan_id"),
        F.col("o_totalprice").cast("double").alias("credit_amount"),
        F.col("c_acctbal").cast("double").alias("acct_balance"),
        F.coalesce(F.col("li_n"), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.col("li_qty"), F.lit(0.0)).cast("double").alias("total_qty"),
        F.col("o_orderpriority").alias("priority"),
        F.col("c_mktsegment").alias("segment"),
        F.col("r_name").alias("region"),
        pm.alias("pm"),
        (_hex_int(digest, 1) % 1000).alias("u"),
        (_hex_int(digest, 9) % 1000000).alias("u2"),
    )
    target = F.when(F.col("u") < F.col("pm"), 1).otherwise(0).cast("bigint")
    return out.select(
        "loan_id", "credit_amount", "acct_balance", "n_lines", "total_qty",
        "priority", "segment", "region", "pm", "u",
        target.alias("target"),
        (F.lit(1) - target).alias("raw_target"),
        (F.col("pm").cast("double") / 1000).alias("pd"),
        (F.col("pm").cast("double") / 1000 + F.col("u2").cast("double") / 1000000000).alias("pd_fine"),
    )


# Same view for DuckDB; used as a CTE by every oracle query.
LOAN_BOOK_SQL = """
loan_book AS (
  SELECT loan_id, credit_amount, acct_balance, n_lines, total_qty, priority, segment, region, pm, u,
         CAST(CASE WHEN u < pm THEN 1 ELSE 0 END AS BIGINT) AS target,
         CAST(1 - CASE WHEN u < pm THEN 1 ELSE 0 END AS BIGINT) AS raw_target,
         CAST(pm AS DOUBLE) / 1000 AS pd,
         CAST(pm AS DOUBLE) / 1000 + CAST(u2 AS DOUBLE) / 1000000000 AS pd_fine
  FROM (
    SELECT CAST(o.o_orderkey AS BIGINT) AS loan_id,
           CAST(o.o_totalprice AS DOUBLE) AS credit_amount,
           CAST(c.c_acctbal AS DOUBLE) AS acct_balance,
           CAST(COALESCE(li.li_n, 0) AS BIGINT) AS n_lines,
           CAST(COALESCE(li.li_qty, 0) AS DOUBLE) AS total_qty,
           o.o_orderpriority AS priority,
           c.c_mktsegment AS segment,
           r.r_name AS region,
           CAST(120
             + CASE WHEN o.o_orderpriority = '1-URGENT' THEN 260 WHEN o.o_orderpriority = '2-HIGH' THEN 140
                    WHEN o.o_orderpriority = '3-MEDIUM' THEN 60 ELSE 0 END
             + CASE WHEN c.c_acctbal < 0 THEN 220 WHEN c.c_acctbal < 2500 THEN 80 ELSE 0 END
             + CASE WHEN o.o_totalprice > 400000 THEN 200 WHEN o.o_totalprice > 200000 THEN 60 ELSE 0 END
             AS BIGINT) AS pm,
           ('0x' || substr(md5('d-' || CAST(o.o_orderkey AS VARCHAR)), 1, 8))::BIGINT % 1000 AS u,
           ('0x' || substr(md5('d-' || CAST(o.o_orderkey AS VARCHAR)), 9, 8))::BIGINT % 1000000 AS u2
    FROM orders o
    LEFT JOIN (SELECT l_orderkey, COUNT(*) AS li_n, SUM(l_quantity) AS li_qty FROM lineitem GROUP BY l_orderkey) li
           ON o.o_orderkey = li.l_orderkey
    LEFT JOIN customer c ON o.o_custkey = c.c_custkey
    LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
    LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
  ) base
)
"""


def with_loan_book(sql_body: str) -> str:
    """Prefix an oracle query with the loan_book CTE (the body may add CTEs
    with a leading comma)."""
    body = sql_body.strip()
    if body.startswith(","):
        return "WITH " + LOAN_BOOK_SQL + body
    return "WITH " + LOAN_BOOK_SQL + "\n" + body
