"""From documents to packed training sequences: five stages, each written as
Parquet and read again by the next.

1. quality: documents that the factorisation machine rejects go (op 9);
2. line_dedup: globally repeated runs of two or more lines are removed, and
   with them documents of which nothing is left (op 8);
3. near_duplicates: one document of each group of near duplicates stays, five
   words and a similarity of 0.8 (op 5);
4. mixing: a budget of tokens through domain, language and source (op 4);
5. packing: the documents' tokens in bins of 2,048 (op 10).

All but the last return the columns of documents, any further columns with
their own values, whatever their names.  Every row is a document of its own,
whatever its id (null, shared or not): rows with different texts under one id
all stay, of near-duplicate rows the first one stays.  Ties: equal documents
are interchangeable.  Texts are handled whole, however long.  Documents
without words leave at the mixing stage, as they give no tokens.  Empty tables
give no rows.  In packing no bin has two pieces of one text; as near copies
are gone by then, that constraint rarely binds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscope.llm import line_dedup, mixing, ngram_join, packing, quality
from lendscope.llm.common import held_out, split_by_ids
from lendscope.session import discard, materialize, passing_tables
from lendscope.sources.tables import read_table

MIX_PERCENT = 80
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def private(docs: DataFrame):
    """``docs`` with the columns that no operator knows under private names,
    and the way back to the columns of ``docs``."""
    own = {c: c if c in COLUMNS else f"__user{i}" for i, c in enumerate(docs.columns)}
    return (docs.select(*[F.col(f"`{c}`").alias(a) for c, a in own.items()]),
            lambda df: df.select(*[F.col(a).alias(c) for c, a in own.items()]))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, back = private(docs)
    labels = read_table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, ~held_out(F.col("doc_id"), 5, 0))
    return back(quality.score(docs, model, 0.3).where("predicted = 1"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, back = private(docs)
    got = line_dedup.dedup_runs(docs)
    return back(got.where((F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0)))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__row``, a number of its own for every row: the doc_id
    where it is one row's alone, so that the first document of a group stays;
    numbers above all ids for rows whose id is null or shared."""
    spark = docs.sparkSession
    shared = docs.groupBy(F.col("doc_id").alias("__shared")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 and __shared is not null")
    shared = materialize(spark, shared.select("__shared"), "pipeline-shared-ids")   # written, so that its size is known to the optimizer
    top = max(docs.agg(F.max("doc_id").alias("top")).first()["top"] or 0, 0) + 1
    if top >= 1 << 62:
        raise ValueError("doc_id leaves no room for the numbers of rows that share one")
    named = (docs.where("doc_id is not null").join(shared, F.col("doc_id") == F.col("__shared"), "left")
             .unionByName(docs.where("doc_id is null").withColumn("__shared", F.lit(None).cast("long"))))
    odd = F.col("doc_id").isNull() | F.col("__shared").isNotNull()
    return named.withColumn("__row", F.when(odd, F.lit(top) + F.monotonically_increasing_id()).otherwise(F.col("doc_id").cast("long"))).drop("__shared")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, back = private(docs)
    rows = materialize(spark, keyed(docs), "pipeline-rows")
    gone = (ngram_join.join(rows.select(F.col("__row").alias("doc_id"), "text"), 5, 80).where("doc_id <> component_id")
            .select(F.col("doc_id").alias("__gone")))
    gone = materialize(spark, gone, "pipeline-near-copies")
    some, others = split_by_ids(rows, "__row", gone)           # all other rows stay where they are
    return back(some.join(gone, F.col("__row") == F.col("__gone"), "left_anti").unionByName(others))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, back = private(docs)
    named = docs.withColumn("domain", mixing.domain_of(F.col("source")))
    budget = F.expr(f"(supply * {MIX_PERCENT}) div 100")
    return back(mixing.mix(named, mixing.LEVELS, mixing.WEIGHTS, budget, max_epochs=1))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, mixing.token_count(F.col("text")), F.col("source"), packing.text_cluster(F.col("text")), 2048)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Models, hash boundaries and the packing order can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with passing_tables() as keep:
            before, docs = docs, keep(materialize(spark, stage(spark, docs, sf_dir), f"pipeline-{name}"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
