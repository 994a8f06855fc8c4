"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained
jointly in numpy.

A word stands for the vectors of its character n-grams (3 to 6 characters
with a boundary mark on either side, hashed to ``BUCKETS`` rows), so unseen
misspellings share most vectors with the words they are made from.  Runs of
``WINDOW`` words of a text are averaged to one vector each and a linear
softmax over the two classes reads it; a document's log-odds are those of its
most toxic run, so a long clean text doesn't hide a short passage.  Vectors
and softmax weights are trained together (in numpy, on a bounded labelled
sample).

As the softmax is linear, a run's log-odds are the mean of one number per
n-gram: scoring needs a table of ``BUCKETS`` numbers and cumulative sums over
the text, all in numpy inside Arrow tasks, over every whole text.

Defined results: null and empty texts, and texts without words, get the
score of the bias alone; with no labelled rows of both kinds every score is
the share of label 1 (0 if there are no labels).  Repeated rows get equal
scores.  Columns other than those named are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf as tb
from .common import labelled_sample, map_texts

BUCKETS = 1 << 16
SHORTEST, LONGEST = 3, 6
WINDOW = 4
DIM = 8
TOP, CLEAN = 2, 6
UNIT = float(1 << 32)

_word_char = None


def _is_word(cp):
    """Letters and digits; characters beyond the first plane count as letters."""
    global _word_char
    if _word_char is None:
        _word_char = np.array([chr(i).isalnum() for i in range(1 << 16)])
    return np.where(cp < (1 << 16), _word_char[np.minimum(cp, (1 << 16) - 1)], True)


@dataclass
class Model:
    bias: float          # log-odds without any word
    table: np.ndarray    # log-odds of each n-gram bucket


def _characters(views):
    """Lower-cased characters of the texts, one mark before each and at the
    end, and each text's start."""
    parts, starts, at = [np.zeros(1, np.uint32)], [], 1
    for v in views:
        cp = np.frombuffer(bytes(v).decode("utf-8", "replace").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        starts.append(at)
        parts += [cp, np.zeros(1, np.uint32)]
        at += len(cp) + 1
    return np.concatenate(parts), np.array([*starts, at], dtype=np.int64)


def ngrams(views):
    """For a slice of texts: the n-gram bucket at each position for each
    length (-1 where none), the words' first and last positions with marks,
    and the number of each text's first word."""
    cp, starts = _characters(views)
    word = _is_word(cp)
    word[0] = word[-1] = False
    sep = np.flatnonzero(~word)
    begin = np.flatnonzero(~word[:-1] & word[1:])       # the mark before the word
    end = np.flatnonzero(word[:-1] & ~word[1:]) + 1     # the mark after it
    following = sep[np.minimum(np.cumsum(~word), len(sep) - 1)]  # next mark after each position
    value = tb.mix(np.where(word, cp, 0).astype(tb.U64) + tb.U64(1))
    up, down = tb._powers.get(len(cp) + 1)
    total = np.empty(len(cp) + 1, dtype=tb.U64)
    total[0] = 0
    np.cumsum(value * up[:len(cp)], out=total[1:])
    buckets = []
    for n in range(SHORTEST, LONGEST + 1):
        m = max(len(cp) - n + 1, 0)
        h = tb.mix((total[n:n + m] - total[:m]) * down[:m] + tb.U64(n))
        b = (h % tb.U64(BUCKETS)).astype(np.int32)
        b[np.arange(m) + n - 1 > following[:m]] = -1
        buckets.append(b)
    return buckets, begin, end, np.searchsorted(begin + 1, starts), len(cp)


def log_odds(model: Model, views) -> np.ndarray:
    buckets, begin, end, first, n = ngrams(views)
    # whole numbers, so that a text's sums don't depend on what stands before it
    padded = np.append(np.rint(model.table * UNIT), 0).astype(np.int64)
    value, count = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for b in buckets:
        value[1:len(b) + 1] += padded[b]
        count[1:len(b) + 1] += b >= 0
    value, count = np.cumsum(value), np.cumsum(count)
    words = np.diff(first)
    out = np.full(len(words), model.bias)
    if not len(begin):
        return out
    # runs of WINDOW words: first word of each, and the position after its last
    runs = -(-words // WINDOW)
    doc = np.repeat(np.arange(len(words)), runs)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs)
    lo = first[:-1][doc] + at * WINDOW
    hi = np.minimum(lo + WINDOW, first[1:][doc]) - 1
    a, z = begin[lo], end[hi]
    k = count[z] - count[a]
    odds = np.where(k > 0, (value[z] - value[a]) / (UNIT * np.maximum(k, 1)), 0.0) + model.bias
    best = np.full(len(words), -np.inf)
    np.maximum.at(best, doc, odds)
    return np.where(np.isfinite(best), best, model.bias)


def fit_rows(rows: list, steps: int = 30_000, rate: float = 20.0, seed: int = 5) -> Model:
    """rows: (y, buckets, run sizes); vectors and softmax trained jointly by
    gradient steps, about ``steps`` documents seen in 10 to 60 rounds.

    A toxic document teaches by its ``TOP`` most toxic runs, a clean one by
    its most toxic run and ``CLEAN`` runs chosen at random.  Plain steps for
    the vectors (falling rate): n-grams that many toxic documents share move
    further than those of one document."""
    ones = sum(r[0] for r in rows)
    if not 0 < ones < len(rows):
        share = min(max(ones / len(rows) if rows else 1e-6, 1e-6), 1 - 1e-6)
        return Model(float(np.log(share / (1 - share))), np.zeros(BUCKETS))
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    soft = rng.normal(0, 0.5, (2, DIM))
    b, gb, gs = np.zeros(2), np.full(2, 1e-2), np.full((2, DIM), 1e-2)
    rounds = max(10, min(60, steps // len(rows)))
    for e in range(rounds):
        now = rate * (1 - e / rounds)
        for i in rng.permutation(len(rows)):
            y, ids, sizes = rows[i]
            if not len(ids):
                continue
            cuts = np.cumsum(sizes) - sizes
            odds = np.add.reduceat(emb[ids] @ (soft[1] - soft[0]), cuts) / sizes
            if y:
                runs = np.argsort(-odds, kind="stable")[:TOP]
            else:
                runs = np.unique(np.append(rng.integers(0, len(sizes), CLEAN), np.argmax(odds)))
            for k in runs:
                own = ids[cuts[k]:cuts[k] + sizes[k]]
                x = emb[own].mean(axis=0)
                z = soft @ x + b
                p = np.exp(z - z.max())
                g = p / p.sum() - np.array([1 - y, y])
                ds = np.outer(g, x)
                emb[own] -= now * (g @ soft) / len(own)
                gs += ds * ds
                soft -= 0.3 * ds / np.sqrt(gs)
                gb += g * g
                b -= 0.06 * g / np.sqrt(gb)
    return Model(float(b[1] - b[0]), emb @ (soft[1] - soft[0]))


def _sample(batches):
    for batch in batches:
        views, y = tb.utf8_views(batch.column(0)), batch.column(1).to_pylist()
        out = []
        for i, v in enumerate(views):
            buckets, begin, end, first, n = ngrams([v])
            table = np.full((n, LONGEST - SHORTEST + 1), -1, np.int32)
            for j, b in enumerate(buckets):
                table[:len(b), j] = b
            ids, sizes = [], []
            for lo in range(0, len(begin), WINDOW):
                got = table[begin[lo]:end[min(lo + WINDOW, len(begin)) - 1]].ravel()
                got = got[got >= 0]
                if len(got):
                    ids.append(got)
                    sizes.append(len(got))
            ids = np.concatenate(ids) if ids else np.empty(0, np.int32)
            out.append((y[i], ids.astype(np.uint16).tobytes(), np.array(sizes, np.int32).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary()),
                                          pa.array([o[2] for o in out], pa.binary())], names=["y", "ids", "sizes"])


def fit(docs: DataFrame, labels: DataFrame, train, per_class: int = 2000) -> Model:
    """Fit on at most about ``per_class`` documents of either label whose id
    fulfils ``train``.  The balanced sample is the prior: a score over one
    half means that a document is more like the toxic half of the sample."""
    sample = labelled_sample(docs, labels, "toxic", train, per_class)
    got = sample.select("text", F.col("y").cast("int").alias("y")).mapInArrow(_sample, "y int, ids binary, sizes binary").collect()
    rows = sorted((int(r["y"]), bytes(r["ids"]), bytes(r["sizes"])) for r in got)
    return fit_rows([(y, np.frombuffer(i, np.uint16), np.frombuffer(s, np.int32)) for y, i, s in rows])


def score(docs: DataFrame, model: Model, threshold: float = 0.7, carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` of ``docs`` (default: all) with ``score`` and
    ``predicted`` (clashing columns of those names are replaced)."""
    def run(views, batch):
        out = np.empty(len(views))
        for lo, hi in tb.slices(views, tb.SLICE // 2):
            out[lo:hi] = 1 / (1 + np.exp(-np.clip(log_odds(model, views[lo:hi]), -500, 500)))
        return [pa.array(out)]

    return (map_texts(docs, run, "score double", [], carry, drop=["predicted"])
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
