"""LM scoring by cross-entropy difference.

Two word bigram models share one vocabulary: the target model learns from the
documents the caller marks, the background model from all documents, its
counts scaled to the target's size so that both are smoothed alike:

    P1(w) = (c(w) + A) / (N + A * V),  P(w | v) = (c(v w) + M * P1(w)) / (c(v) + M)

A document's score is the mean over its words of the loss under the target
model less the loss under the background model: negative for texts that are
more like the target.

``score_grams`` (what the query uses) counts every distinct word and bigram of
the corpus under a 64-bit key of its own (hashes of 63 bits and one for the
kind; no slots that different n-grams share), V being the number of distinct
words.  The model grows with the corpus and is never in one place: documents
are written once in batches of about ``BATCH_TEXT`` bytes of text; a batch
sends its distinct n-grams with their counts, one sorted array for each of the
parts that the keys are dealt to; a part (about ``PART_TEXT`` bytes of text a
part, by hash: a frequent n-gram is one entry per batch) sums them and answers
every batch with the totals of the keys it asked for; batch and answers meet
by the batch's number, where the losses are computed.  Nothing of it reaches
the driver but the number of bytes.

``counts`` and ``score`` are the same models in hashed slots of a fixed size
(``VOCABULARY`` words, ``BIGRAMS`` bigrams) at every input, which are summed
on the driver; rarer n-grams of a corpus with more than that share slots, so
they are for small collections only.

Defined results: null and empty texts and texts without words have no tokens
and null losses and score; if no document is marked, the target model knows
nothing and is uniform.  Repeated rows count as often as they occur and get
equal scores.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from . import textbuf as tb
from .common import bounded_batches, map_texts

VOCABULARY = 1 << 18
BIGRAMS = 1 << 20
PARTS = 64
ADD = 0.1
PRIOR = 50.0
SIZE = VOCABULARY + 1 + BIGRAMS     # words, the start mark, bigrams
_EACH = -(-SIZE // PARTS)
BATCH_TEXT = 8 << 20
PART_TEXT = 16 << 20
START = tb.U64(0)                   # key of the start mark, as a context


def slots(views):
    """Word slots and bigram slots of a slice of texts, and each text's first
    word (one more entry than texts)."""
    buf, starts = tb.joined(views)
    h, first, _, _ = tb.words_of(buf, starts)
    word = (h % tb.U64(VOCABULARY)).astype(np.int64)
    before = np.empty_like(word)
    before[1:] = word[:-1]
    begin = first[:-1][np.diff(first) > 0]
    before[begin] = VOCABULARY
    pair = (tb.mix(before.astype(tb.U64) * tb.U64(VOCABULARY + 1) + word.astype(tb.U64)) % tb.U64(BIGRAMS)).astype(np.int64)
    return word, before, pair, first


def encode(x: np.ndarray) -> bytes:
    """Counts as one byte each (255: see the list of larger ones), compressed."""
    x = x.ravel()
    large = np.flatnonzero(x >= 255)
    head = np.array([len(large)], np.int64).tobytes()
    return zlib.compress(head + large.astype(np.int64).tobytes() + x[large].tobytes() + np.minimum(x, 255).astype(np.uint8).tobytes(), 1)


def decode(blob: bytes) -> np.ndarray:
    data = zlib.decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    x = np.frombuffer(data, np.uint8, offset=8 + 16 * n).astype(np.int64)
    x[np.frombuffer(data, np.int64, n, 8)] = np.frombuffer(data, np.int64, n, 8 + 8 * n)
    return x.reshape(2, _EACH)


def _count(batches):
    """Per task: counts of the target (row 0) and of all documents (row 1)."""
    total = np.zeros((2, _EACH * PARTS), dtype=np.int64)
    for batch in batches:
        views, target = tb.utf8_views(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi in tb.slices(views):
            word, before, pair, first = slots(views[lo:hi])
            start = np.diff(first) > 0
            mark = np.repeat(target[lo:hi], np.diff(first))
            for k, (use, begun) in enumerate(((mark, target[lo:hi] & start), (slice(None), start))):
                total[k, :VOCABULARY] += np.bincount(word[use], minlength=VOCABULARY)
                total[k, VOCABULARY] += int(begun.sum())
                total[k, VOCABULARY + 1:SIZE] += np.bincount(pair[use], minlength=BIGRAMS)
    if total.any():
        for p in range(PARTS):
            piece = total[:, p * _EACH:(p + 1) * _EACH]
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([encode(piece)], pa.binary())], names=["part", "counts"])


def _add(batches):
    """Sums the arrays of each piece as they stream in."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for p, c in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = decode(c.as_py())
            sums[p] = sums[p] + x if p in sums else x
    for p, x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([encode(x)], pa.binary())], names=["part", "counts"])


def counts(docs: DataFrame, target: Column) -> np.ndarray:
    """2 x SIZE counts: marked documents, all documents."""
    bounded_batches(docs.sparkSession)
    schema = "part int, counts binary"
    rows = (docs.select(F.col("text").cast("string"), F.coalesce(target, F.lit(False)).alias("t")).mapInArrow(_count, schema)
            .repartitionById(PARTS, "part").mapInArrow(_add, schema).collect())
    out = np.zeros((2, _EACH * PARTS), dtype=np.int64)
    for r in rows:
        out[:, r["part"] * _EACH:(r["part"] + 1) * _EACH] = decode(r["counts"])
    return out[:, :SIZE]


def models(count: np.ndarray) -> np.ndarray:
    """Counts of both models as floats, the background scaled to the target's
    number of words."""
    out = count.astype(np.float32)
    n = count[:, :VOCABULARY].sum(axis=1)
    if n[1] and n[0]:
        out[1] *= n[0] / n[1]
    return out


def losses(model: np.ndarray, n_words: float, word, before, pair) -> np.ndarray:
    """Negative log probability of each word."""
    one = (model[word] + ADD) / (n_words + ADD * VOCABULARY)
    return -np.log((model[VOCABULARY + 1 + pair] + PRIOR * one) / (model[before] + PRIOR))


def score(docs: DataFrame, count: np.ndarray, carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` of ``docs`` (default: all) with n_tokens, ce_target,
    ce_background (mean losses in nats) and score, their difference."""
    both = docs.sparkSession.sparkContext.broadcast(models(count))

    def run(views, batch):
        model = both.value
        n_words = [float(m[:VOCABULARY].sum(dtype=np.float64)) for m in model]
        n, ce = np.zeros(len(views), np.int64), np.zeros((2, len(views)))
        for lo, hi in tb.slices(views):
            word, before, pair, first = slots(views[lo:hi])
            n[lo:hi] = np.diff(first)
            doc = np.repeat(np.arange(hi - lo), np.diff(first))
            for k in range(2):
                ce[k, lo:hi] = np.bincount(doc, losses(model[k], n_words[k], word, before, pair), hi - lo)
        none = n == 0
        mean = ce / np.maximum(n, 1)
        return [pa.array(n), *[pa.array(x, mask=none) for x in (mean[0], mean[1], mean[0] - mean[1])]]

    return map_texts(docs, run, "n_tokens long, ce_target double, ce_background double, score double", [], carry)


def pack(*arrays) -> bytes:
    """Arrays of non-negative 64-bit integers of equal lengths, compressed by byte planes."""
    x = np.concatenate([np.asarray(a).astype(tb.U64) for a in arrays])
    raw = x.view(np.uint8).reshape(-1, 8).T.tobytes()
    return np.array([len(x)], np.int64).tobytes() + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unpack(blob: bytes, n: int) -> np.ndarray:
    """The ``n`` arrays of ``pack`` as the rows of a matrix of unsigned integers."""
    size = int(np.frombuffer(blob, np.int64, 1)[0])
    raw = pa.Codec("zstd").decompress(blob[8:], decompressed_size=8 * size, asbytes=True) if size else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, size).T).view(tb.U64).reshape(n, -1)


def grams(views):
    """Of a batch of texts: its distinct keys in order (the start mark first,
    words even, bigrams odd), and as indexes into them the words, the words
    before them and the bigrams; each text's first word (one more entry than
    texts)."""
    words, firsts, at = [], [np.zeros(1, np.int64)], 0
    for lo, hi in tb.slices(views):
        buf, starts = tb.joined(views[lo:hi])
        h, first, _, _ = tb.words_of(buf, starts)
        words.append(h & ~tb.U64(1))
        firsts.append(first[1:] + at)
        at += len(h)
    word = np.concatenate(words) if words else np.empty(0, tb.U64)
    first = np.concatenate(firsts)
    before = np.empty_like(word)
    before[1:] = word[:-1]
    begin = first[:-1][np.diff(first) > 0]
    before[begin] = START
    pair = tb.mix(before * tb._P + word) | tb.U64(1)
    keys, index = np.unique(np.concatenate([[START], word, pair]), return_inverse=True)
    n = len(word)
    word, pair = index[1:n + 1], index[n + 1:]
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[begin] = 0
    return keys, word, before, pair, first


def bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part of sorted keys begins and the last one ends."""
    edge = np.array([(p << 64) // parts for p in range(parts)], dtype=tb.U64)
    return np.append(np.searchsorted(keys, edge), len(keys))


def score_grams(docs: DataFrame, target: Column, carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` of ``docs`` (default: all) with n_tokens, ce_target,
    ce_background (mean losses in nats) and score, their difference, under
    exact counts of the documents marked by ``target`` and of all."""
    spark = docs.sparkSession
    bounded_batches(spark)
    new = T.StructType.fromDDL("n_tokens long, ce_target double, ce_background double, score double")
    keep = [c for c in (docs.columns if carry is None else carry) if c.lower() not in {f.name for f in new.fields}]
    carried = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = T.StructType(carried.schema.fields + new.fields)
    names = schema.names

    def gather(batches):
        """Rows in batches, each as one compressed Arrow stream."""
        task = TaskContext.get().partitionId() << 32

        def sealed(held, size):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for b in held:
                    out.write_batch(b)
            return pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([size], pa.int64()),
                                               pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch", "size", "body"])
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += sum(map(len, tb.utf8_views(batch.column(0))))
            if size >= BATCH_TEXT:
                yield sealed(held, size)
                held, size, task = [], 0, task + 1
        if held:
            yield sealed(held, size)

    rows = docs.select(F.col("text").cast("string").alias("__text"), F.coalesce(target, F.lit(False)).alias("__target"),
                       *[F.col(f"`{c}`") for c in keep])
    home = materialize(spark, rows.mapInArrow(gather, "batch long, size long, body binary"), "lm-batches")
    parts = max(PARTS, -(-(home.agg(F.sum("size")).first()[0] or 0) // PART_TEXT))

    def opened(body):
        # one chunk a column; texts as Spark sent them
        table = pa.ipc.open_stream(body).read_all().combine_chunks()
        return table, tb.utf8_views(table.column(0))

    def send(batches):
        """Each batch's distinct n-grams and their counts in marked and in all
        documents, by part."""
        for batch in batches:
            for number, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                table, views = opened(body.as_buffer())
                keys, word, before, pair, first = grams(views)
                mark = table.column(1).to_numpy().astype(bool)
                in_target = np.repeat(mark, np.diff(first))
                starts = np.diff(first) > 0
                count = [np.bincount(word[use], minlength=len(keys)) + np.bincount(pair[use], minlength=len(keys)) for use in (in_target, slice(None))]
                count[0][0], count[1][0] = (starts & mark).sum(), starts.sum()
                at = bounds(keys, parts)
                out = [pack(np.diff(keys[lo:hi], prepend=START), count[0][lo:hi], count[1][lo:hi]) for lo, hi in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([number] * parts, pa.int64()),
                                                  pa.array(out, pa.binary())], names=["part", "batch", "body"])

    def answer(batches):
        """The totals of a part: for each batch, of the keys it asked for,
        and in front the part's number of words in marked and in all documents
        and its distinct words."""
        number, part, keys, counts = [], None, [], []
        for batch in batches:
            for p, b, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                x = unpack(body.as_py(), 3)
                part = p
                number.append(b)
                keys.append(np.cumsum(x[0], dtype=tb.U64))
                counts.append(x[1:].astype(np.int64))
        if not number:
            return
        size = np.cumsum([0] + [len(k) for k in keys])
        key, index = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        # exact: sums below 2^53
        total = np.array([np.bincount(index, np.concatenate([c[k] for c in counts]), len(key)) for k in range(2)]).astype(np.int64)
        words = (key & tb.U64(1) == 0) & (key != START)
        front = np.array([[*total[:, words].sum(axis=1)], [words.sum(), 0]], np.int64)
        for i, b in enumerate(number):
            got = np.concatenate([front, total[:, index[size[i]:size[i + 1]]]], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([part], pa.int32()),
                                              pa.array([pack(got[0], got[1])], pa.binary())], names=["batch", "part", "body"])

    def finish(body, answers):
        table, views = opened(body)
        keys, word, before, pair, first = grams(views)
        got = [unpack(a, 2).astype(np.int64) for a in answers]
        if [g.shape[1] - 2 for g in got] != np.diff(bounds(keys, parts)).tolist():
            raise RuntimeError("a batch of documents and the counts for it don't match")
        n, vocabulary = [sum(int(g[0, k]) for g in got) for k in range(2)], sum(int(g[1, 0]) for g in got)
        count = np.concatenate([g[:, 2:] for g in got], axis=1).astype(float)
        scale = n[0] / n[1] if n[0] and n[1] else 1.0
        tokens = np.diff(first)
        doc = np.repeat(np.arange(len(views)), tokens)
        mean = []
        for c, total in ((count[0], n[0]), (count[1] * scale, n[1] * scale)):
            one = (c[word] + ADD) / (total + ADD * vocabulary)
            loss = -np.log((c[pair] + PRIOR * one) / (c[before] + PRIOR))
            mean.append(np.bincount(doc, loss, len(views)) / np.maximum(tokens, 1))
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns[2:]]
        columns += [pa.array(tokens)] + [pa.array(x, mask=tokens == 0) for x in (*mean, mean[0] - mean[1])]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def meet(batches):
        """Batches of documents (part -1), each followed by its answers in order."""
        at, body, answers = None, None, []
        for batch in batches:
            for b, p, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if b != at:
                    if at is not None:
                        yield finish(body, answers)
                    at, body, answers = b, None, []
                if p < 0:
                    body = x.as_py()
                else:
                    answers.append(x.as_py())
        if at is not None:
            yield finish(body, answers)

    answers = (home.select("batch", "body").mapInArrow(send, "part int, batch long, body binary")
               .repartitionById(parts, "part").mapInArrow(answer, "batch long, part int, body binary"))
    return (home.select("batch", F.lit(-1).alias("part"), "body").unionByName(answers)
            .repartition(parts, "batch").sortWithinPartitions("batch", "part").mapInArrow(meet, schema))


def good_ids(labels: DataFrame) -> DataFrame:
    """Ids that every one of their label rows marks as of good quality and not toxic."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return (labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce(good, F.lit(False)).cast("int")).alias("g"))
            .where("g = 1").select(F.col("doc_id").alias("__good")))
