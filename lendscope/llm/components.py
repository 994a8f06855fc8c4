"""Connected components of a link table by alternating large-star and
small-star rounds, each one join and one aggregate; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize


def _is_done(e: DataFrame) -> bool:
    """Each node that points somewhere points to one node, which points
    nowhere: the table is stars around the components' smallest ids."""
    nodes = (e.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into"))
             .unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into"))))
    bad = nodes.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out = 1 and into = 1)")
    return bad.agg(F.count(F.lit(1)).alias("n")).first()["n"] == 0


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> (id, component): every linked id with the smallest
    id reachable.  Links are undirected; loops, repeats and nulls are ignored.

    Large-star: each node's larger neighbours are linked to its smallest
    neighbour (or itself); small-star: its smaller neighbours and itself to
    the smallest of them.  The table ends as stars around the smallest ids;
    rounds are about the logarithm of a component's width.  Each round is
    written to the shared folder, so lineage stays short."""
    spark = links.sparkSession
    e = (links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    e = materialize(spark, e, "components")
    while not _is_done(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        old, e = e, materialize(spark, small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "components")
        discard(old)
    members = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
