"""Conflict-constrained best-fit packing of documents into fixed-size bins.

A document's tokens are cut into pieces of at most ``capacity`` (all but the
last are full and get a bin each); pieces in falling size go to the
bin with the smallest residual that holds them, unless the bin already has a
piece of the same source or of the same duplicate cluster; the search then
goes on to the next bin in residual order until a compatible one is found,
else a new bin is opened.  Bins are kept ordered by residual (a bitmap of the
residuals in use gives the successor); each bin carries a bitmap of sources
and one of duplicate clusters.

Spark deals the pieces out by a hash of id and content, so a hot source or a
large group of copies spreads evenly; inside a partition they stream in hash
order through batches of ``batch`` pieces, each packed on its own, so a
task's memory is bounded whatever the partition holds.  Every piece of every
document is placed exactly once.

Defined results: documents without tokens (null or empty text) have no piece
and no row; a null source or cluster conflicts with nothing; rows that repeat
are pieces like others.  Bin ids are text: partition, batch and number.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches


class Bins:
    """Open bins of one batch, ordered by residual."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.used = 0            # bit r: some bin has residual r
        self.at = {}             # residual -> bins, oldest first
        self.residual, self.sources, self.clusters, self.count = [], [], [], []

    def place(self, size: int, source: int, cluster: int) -> int:
        """The tightest compatible bin's number, or a new one's; ``source``
        and ``cluster`` are bitmaps of one bit (0: no conflict)."""
        rest = self.used >> size
        r = size
        while rest:
            step = (rest & -rest).bit_length() - 1
            r += step
            for b in self.at[r]:
                if not (self.sources[b] & source or self.clusters[b] & cluster):
                    self._move(b, r, r - size)
                    self.sources[b] |= source
                    self.clusters[b] |= cluster
                    return b
            rest >>= step + 1
            r += 1
        b = len(self.residual)
        self.residual.append(self.capacity)
        self.sources.append(source)
        self.clusters.append(cluster)
        self.count.append(0)
        self._move(b, None, self.capacity - size)
        return b

    def _move(self, b: int, old, new: int):
        if old is not None:
            del self.at[old][b]
            if not self.at[old]:
                del self.at[old]
                self.used &= ~(1 << old)
        self.at.setdefault(new, {})[b] = None
        self.used |= 1 << new
        self.residual[b] = new
        self.count[b] += 1


def pack_batch(pieces: list, capacity: int) -> list:
    """pieces: (size, source, cluster) -> (bin, offset) of each."""
    source_bit, cluster_bit, out = {}, {}, [None] * len(pieces)
    bins = Bins(capacity)
    for i in sorted(range(len(pieces)), key=lambda i: (-pieces[i][0], i)):
        size, source, cluster = pieces[i]
        s = 0 if source is None else 1 << source_bit.setdefault(source, len(source_bit))
        c = 0 if cluster is None else 1 << cluster_bit.setdefault(cluster, len(cluster_bit))
        b = bins.place(size, s, c)
        out[i] = (b, capacity - bins.residual[b] - size)
    return out


def text_cluster(text: Column) -> Column:
    """A duplicate cluster for each text: equal apart from case and spacing."""
    return F.md5(F.regexp_replace(F.trim(F.lower(text)), r"\s+", " "))


def pack(docs: DataFrame, tokens: Column, source: Column, cluster: Column, capacity: int = 2048, batch: int = 2048,
         rows_per_task: int = 50_000) -> DataFrame:
    """(doc_id, piece, bin, start, tokens): the piece's bin and its first
    token's place in it.  ``docs`` has doc_id; ``tokens``, ``source`` and
    ``cluster`` are expressions over it."""
    slim = docs.select("doc_id", tokens.cast("long").alias("n"), source.cast("string").alias("s"),
                       cluster.cast("string").alias("c")).where("n > 0")
    pieces = (slim.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {capacity}"))))
              .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("piece").cast("int").alias("piece"),
                      F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int").alias("size"), "s", "c")
              .withColumn("h", F.xxhash64("doc_id", "piece", "size", "s", "c")))
    bounded_batches(docs.sparkSession)
    tasks = max(1, -(-docs.count() // rows_per_task))

    def run(batches):
        part = TaskContext.get().partitionId()
        held, made = [], 0

        def flush():
            got = pack_batch([(x[2], x[3], x[4]) for x in held], capacity)
            return pa.RecordBatch.from_arrays([
                pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.int32()),
                pa.array([f"{part}-{made}-{b}" for b, _ in got], pa.string()),
                pa.array([o for _, o in got], pa.int32()), pa.array([x[2] for x in held], pa.int32())],
                names=["doc_id", "piece", "bin", "start", "tokens"])

        for b in batches:
            for row in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                held.append(row)
                if len(held) == batch:
                    yield flush()
                    held, made = [], made + 1
        if held:
            yield flush()

    dealt = (pieces.repartition(tasks, "h").sortWithinPartitions("h", "doc_id", "piece", "size", "s", "c")
             .select("doc_id", "piece", "size", "s", "c"))
    return dealt.mapInArrow(run, "doc_id long, piece int, bin string, start int, tokens int")
