"""Quality classifier: a factorisation machine over hashed words, structure
statistics and metadata.

score(x) = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]),
so all pairwise interactions cost time linear in the non-zero features (the
sum-of-squares identity).  The inputs of a document are

* its distinct words, hashed to ``WORD_SPACE`` slots, with weight
  log(1 + count) scaled to unit length over the document,
* ``STATS`` structure statistics of the whole text,
* metadata: log of ``n_chars`` and whether it is there.

Fitting reads a bounded sample (``per_class`` documents of either label, a
parameter), featurised on the executors and fitted in numpy by Adagrad on the
driver; scoring runs over every whole text in Arrow batches, slice by slice.

Defined results: a null or empty text has the bias, statistics of zero and
its metadata as inputs and gets a score like any other; a null ``n_chars``
counts as missing; with no labelled rows of both kinds every score is the
share of label 1 (0.5 if there are no labels at all).  Repeated rows get equal
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

WORD_SPACE = 1 << 15
RANK = 4
STATS = 14
META = 2
DENSE = STATS + META
SIZE = WORD_SPACE + DENSE

# byte classes: 0 other, 1 lower case, 2 upper case, 3 digit, 4 sentence punctuation, 5 other ASCII symbols,
# 6 space, 7 line break, 8 non-ASCII
_class = np.zeros(256, dtype=np.int64)
_class[33:127] = 5
_class[97:123], _class[65:91], _class[48:58] = 1, 2, 3
for _b in b".,;:?'\"-()":
    _class[_b] = 4
_class[[32, 9]], _class[[10, 11, 12, 13]], _class[128:] = 6, 7, 8


@dataclass
class Model:
    bias: float
    linear: np.ndarray   # SIZE
    factors: np.ndarray  # SIZE x RANK


def features(views, n_chars):
    """Sparse word features and dense features of a slice of texts:
    (document of each entry, slot, weight, dense matrix)."""
    docs = len(views)
    buf, starts = tb.joined(views)
    h, first, begin, end = tb.words_of(buf, starts)
    n_words = np.diff(first)
    doc_of_word = np.repeat(np.arange(docs), n_words)
    key = doc_of_word * WORD_SPACE + (h % tb.U64(WORD_SPACE)).astype(np.int64)
    uniq, count = np.unique(key, return_counts=True)
    doc, slot = uniq // WORD_SPACE, uniq % WORD_SPACE
    weight = np.log1p(count)
    norm = np.sqrt(np.bincount(doc, weight * weight, docs))
    weight = weight / np.maximum(norm[doc], 1e-12)

    size = np.maximum(np.diff(starts) - 1, 1).astype(float)
    doc_of_byte = np.repeat(np.arange(docs), np.diff(starts))
    by_class = np.bincount(doc_of_byte * 9 + _class[buf[1:]], minlength=docs * 9).reshape(docs, 9)
    letters = np.maximum(by_class[:, 1] + by_class[:, 2] + by_class[:, 8], 1)
    words = np.maximum(n_words, 1).astype(float)
    same = np.zeros(len(h))
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (doc_of_word[1:] == doc_of_word[:-1])
    most = np.zeros(docs)
    np.maximum.at(most, doc, count)
    last = buf[end - 1] if len(end) else np.empty(0, np.uint8)
    odd_end = np.isin(_class[last], (5,)).astype(float)
    lone = ((end - begin) == 1).astype(float) * (_class[buf[begin]] >= 4) if len(begin) else np.empty(0)
    lines = by_class[:, 7]  # the newline after each text counts as its last line's end
    distinct = np.bincount(doc, minlength=docs)
    dense = np.stack([
        np.log1p(n_words) / 10.0,
        by_class[:, 2] / letters,
        by_class[:, 3] / size,
        10 * by_class[:, 5] / size,
        by_class[:, 4] / size * 5,
        by_class[:, 8] / size,
        by_class[:, 6] / size,
        np.bincount(doc_of_word, same, docs) / words,
        distinct / words,
        most / words,
        np.bincount(doc_of_word, odd_end, docs) / words,
        np.bincount(doc_of_word, lone, docs) / words * 5,
        np.minimum(by_class[:, 1:6].sum(axis=1) / words / 10.0, 5.0),
        np.minimum(words / lines / 100.0, 5.0),
        np.log1p(np.maximum(np.nan_to_num(n_chars, nan=0.0), 0)) / 10.0,
        np.isnan(n_chars).astype(float),
    ], axis=1)
    dense[n_words == 0, :STATS] = 0.0
    return doc, slot, weight, dense


def scores(model: Model, doc, slot, weight, dense) -> np.ndarray:
    """Log-odds of a slice by the sum-of-squares identity."""
    docs = len(dense)
    lin = np.bincount(doc, model.linear[slot] * weight, docs) + dense @ model.linear[WORD_SPACE:]
    out = model.bias + lin
    for f in range(model.factors.shape[1]):
        v = model.factors[:, f]
        x = v[slot] * weight
        s = np.bincount(doc, x, docs) + dense @ v[WORD_SPACE:]
        q = np.bincount(doc, x * x, docs) + (dense * dense) @ (v[WORD_SPACE:] ** 2)
        out += 0.5 * (s * s - q)
    return out


def fit_rows(rows: list, epochs: int = 12, rate: float = 0.08, reg: float = 1e-5, seed: int = 11) -> Model:
    """Adagrad over rows (y, slots, weights); classes are weighted equally
    while fitting and the intercept is then set back by the sample's odds."""
    y = np.array([r[0] for r in rows])
    ones, zeros = int((y == 1).sum()), int((y == 0).sum())
    rng = np.random.default_rng(seed)
    model = Model(0.0, np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, RANK)))
    if not ones or not zeros:
        share = ones / len(rows) if rows else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(float(np.log(share / (1 - share))), np.zeros(SIZE), np.zeros((SIZE, RANK)))
    w, v = model.linear, model.factors
    gw, gv, gb, b = np.full(SIZE, 1e-4), np.full((SIZE, RANK), 1e-4), 1e-4, 0.0
    cost = {1: len(rows) / (2 * ones), 0: len(rows) / (2 * zeros)}
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            t, slot, x = rows[i]
            vx = v[slot] * x[:, None]
            s = vx.sum(axis=0)
            z = b + w[slot] @ x + 0.5 * float((s * s).sum() - (vx * vx).sum())
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - t) * cost[int(t)]
            dw = g * x + reg * w[slot]
            dv = g * x[:, None] * (s[None, :] - vx) + reg * v[slot]
            gb += g * g
            b -= rate * g / np.sqrt(gb)
            gw[slot] += dw * dw
            w[slot] -= rate * dw / np.sqrt(gw[slot])
            gv[slot] += dv * dv
            v[slot] -= rate * dv / np.sqrt(gv[slot])
    model.bias = float(b + np.log(ones / zeros))
    return model


def _number(column) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)


def _sample_features(batches):
    for batch in batches:
        views, n_chars = tb.utf8_views(batch.column(0)), _number(batch.column(1))
        y = batch.column(2).to_pylist()
        for lo, hi in tb.slices(views):
            doc, slot, weight, dense = features(views[lo:hi], n_chars[lo:hi])
            cut = np.searchsorted(doc, np.arange(hi - lo + 1))
            out = []
            for i in range(hi - lo):
                s = np.concatenate([slot[cut[i]:cut[i + 1]], np.arange(WORD_SPACE, SIZE)]).astype(np.int32)
                x = np.concatenate([weight[cut[i]:cut[i + 1]], dense[i]]).astype(np.float32)
                out.append((y[lo + i], s.tobytes(), x.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary()),
                                              pa.array([o[2] for o in out], pa.binary())], names=["y", "slots", "weights"])


def fit(docs: DataFrame, labels: DataFrame, train, prior: float | None = None, per_class: int = 1500) -> Model:
    """Fit on at most about ``per_class`` documents of either label whose id
    fulfils ``train``; ``prior`` is the share of label 1 that the scores are
    set to (default: its share among the labels that may be learnt from)."""
    sample = labelled_sample(docs, labels, "quality", train, per_class)
    got = (sample.select("text", F.col("n_chars").cast("double").alias("n_chars"), F.col("y").cast("int").alias("y"), "doc_id")
           .select("text", "n_chars", "y").mapInArrow(_sample_features, "y int, slots binary, weights binary").collect())
    rows = sorted((int(r["y"]), bytes(r["slots"]), bytes(r["weights"])) for r in got)
    data = [(y, np.frombuffer(s, np.int32), np.frombuffer(x, np.float32).astype(float)) for y, s, x in rows]
    model = fit_rows(data)
    ones = sum(y for y, _, _ in rows)
    if 0 < ones < len(rows):
        if prior is None:
            n = labels.where(train).where(F.col("quality").isin(0, 1)).agg(
                F.avg(F.col("quality").cast("double")).alias("p")).first()["p"]
            prior = min(max(n if n is not None else 0.5, 0.01), 0.99)
        model.bias += float(np.log(prior / (1 - prior)) - np.log(ones / (len(rows) - ones)))
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3, carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` of ``docs`` (default: all) with ``score`` and
    ``predicted`` (clashing columns of those names are replaced)."""
    def run(views, batch):
        n_chars, out = _number(batch.column(1)), np.empty(len(views))
        for lo, hi in tb.slices(views):
            z = scores(model, *features(views[lo:hi], n_chars[lo:hi]))
            out[lo:hi] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return [pa.array(out)]

    return (map_texts(docs, run, "score double", ["n_chars"], carry, drop=["predicted"])
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
