"""Shared pieces of the operators: hold-out folds and bounded labelled samples."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, materialize
from . import textbuf as tb


BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let the session hand tasks Arrow batches of at most ``BATCH_BYTES``
    (unless it is set lower): executors hold a batch several times over in
    memory outside the heap, on its way to Python and back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """crc32(doc_id as text) mod ``mod`` is ``rest``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int,
                    seed: int = 7) -> DataFrame:
    """Texts to learn from: (doc_id, text, n_chars, y), about ``per_class``
    documents of either label at most.

    Rows whose id fulfils ``train`` and whose label is 0 or 1 count; ids with
    both labels are left out.  The share taken of a class is ``per_class``
    over its size, decided by a seeded hash of the id, so the sample's size is
    bounded at any size of the tables.  Of rows that repeat an id, one text
    (the smallest) is taken.
    """
    bounded_batches(docs.sparkSession)
    lab = (labels.select("doc_id", F.col(label).cast("int").alias("y"))
           .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & train)
           .groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").drop("z"))
    size = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    space = 1 << 30
    cut = F.lit(0)
    for y, n in size.items():
        cut = F.when(F.col("y") == y, F.lit(min(space, space * per_class // n))).otherwise(cut)
    ids = lab.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(space)) < cut)
    found = docs.select("doc_id", "text", "n_chars").where(F.col("text").isNotNull())
    return (found.join(F.broadcast(ids), "doc_id")
            .groupBy("doc_id").agg(F.min("text").alias("text"), F.min("n_chars").alias("n_chars"), F.min("y").alias("y")))


BITS_PER_ID = 16


def split_by_ids(rows: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``key`` may be in the one column of ``ids``, and all others,
    without a shuffle of ``rows``.

    A bitmap of hashed ids is broadcast, two bytes an id, however sparse they
    are; about one in sixteen of the rows whose id isn't there is told to be
    there, so a join follows.  A null key is among the others."""
    spark = rows.sparkSession
    ids = materialize(spark, ids.toDF("id").where("id is not null").distinct(), "some-ids")
    cells = 32768 * max(1, -(-BITS_PER_ID * ids.count() // 32768))

    def cell(c: str) -> Column:
        return F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(cells))

    bits = (ids.select(F.bitmap_bucket_number(cell("id")).alias("__bucket"), F.bitmap_bit_position(cell("id")).alias("__at"))
            .groupBy("__bucket").agg(F.bitmap_construct_agg("__at").alias("__bits")))
    bits = materialize(spark, bits, "id-bits")
    discard(ids)
    at = F.bitmap_bit_position(cell(key))
    byte = F.conv(F.hex(F.substr("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.col(key).isNotNull() & (F.coalesce(F.getbit(byte, (at % 8).cast("int")), F.lit(0)) == 1)
    told = rows.withColumn("__bucket", F.bitmap_bucket_number(cell(key))).join(F.broadcast(bits), "__bucket", "left").withColumn("__hit", hit)
    return tuple(told.where(side).select(*[f"`{c}`" for c in rows.columns]) for side in (F.col("__hit"), ~F.col("__hit")))


def map_texts(docs: DataFrame, fn, out: str, inputs: list[str], carry: list[str] | None = None,
              drop: list[str] | None = None) -> DataFrame:
    """Add columns computed from whole texts in Arrow batches.

    ``fn(views, batch)`` gets the texts as byte views and the batch of
    columns ("text", *inputs) and returns an Arrow array for each column of
    the DDL string ``out``.  ``carry`` names the columns that come along
    (default: all); columns that clash with the new ones, or are in ``drop``,
    are replaced.
    """
    bounded_batches(docs.sparkSession)
    new = T.StructType.fromDDL(out)
    gone = {f.name.lower() for f in new.fields} | {c.lower() for c in drop or []}
    keep = [c for c in (docs.columns if carry is None else carry) if c.lower() not in gone]
    src = docs.select(F.col("text").cast("string").alias("__text"), *[F.col(c).alias(f"__in_{c}") for c in inputs],
                      *[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([f for f in docs.select(*[F.col(f"`{c}`") for c in keep]).schema.fields] + new.fields)
    first = 1 + len(inputs)

    def run(batches):
        for batch in batches:
            made = fn(tb.utf8_views(batch.column(0)), batch)
            yield pa.RecordBatch.from_arrays([*batch.columns[first:], *made], names=schema.names)

    return src.mapInArrow(run, schema)
