"""Phrase collocation mining by multikey three-way quicksort of suffix pointers.

Texts are cut into pieces at ``[.,;:!?]`` and line ends, pieces into words.
Every word position is a suffix of up to ``max_words`` words within its piece.
Tasks keep each distinct suffix of a batch once, with its count, so a passage
or word that fills a third of all rows is one suffix a batch.  Suffixes are
routed by their leading words: each language's suffixes, in byte order, are
cut into ranges at bounds from a bounded sample (``SAMPLE_ROWS`` at most), so
a frequent leading word is spread over as many ranges as it needs; a batch
sends one packed message to each range it has suffixes for.  There, pointers
to the suffixes are split by multikey three-way quicksort: a segment is
divided at a pivot's word of its depth into less, equal and greater; the equal
part goes on at the next word, and its weight is the count of its phrase, down
to the maximal depth.  A part whose weight is under ``min_count`` is abandoned
at once: its phrases lie nowhere else, except those that begin the first or
last suffix of the range, whose shares are counted apart and added up with the
neighbours'.  The sample decides on balance only, never on results.

All segments of a task are split in the same numpy steps, so a step costs the
pointers that are still alive, not the number of segments.  The frequent
phrases (at most words / ``min_count`` of each length) are joined with
themselves for the counts of both sides of each cut; scores are integer
divisions of decimals.  The first ``top`` of a language come from ranks within
hashed groups first, so no task sorts a language.

Defined results: a null text counts as empty, a null lang as ``und``; texts
without words give nothing; repeated rows count each; ids are not read and
other columns neither; a word may be any bytes but separators; ties go to the
smaller cut and phrase.  Empty tables give no rows.  Texts are read whole: one longer than
a slice is cut after a piece's end, where no phrase passes; memory in the tasks
is bounded by the slice or, beyond, the longest piece, and by the ranges' size
(the suffixes of ``PART_BYTES`` of text).
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import materialize
from . import textbuf as tb
from .common import bounded_batches

BREAKS = b".,;:!?\n\v\f\r"
SPACES = b" \t"
SLICE = 2 << 20
#: Text whose suffixes one task of the sorting step gets, about.
PART_BYTES = 4 << 20
OUT_ROWS = 100_000
#: Sampled suffixes that set the bounds: for each range, at least and at most.
SAMPLE_PER_PART, SAMPLE_LEAST, SAMPLE_ROWS = 64, 20_000, 1_000_000

_kind = np.zeros(256, dtype=np.uint8)
_kind[list(SPACES)] = 1
_kind[list(BREAKS)] = 2
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def pieces(view, limit: int = SLICE):
    """The text in parts of at most about ``limit`` bytes that end after a
    break (a longer piece stays whole)."""
    data, lo = bytes(view) if len(view) > limit else view, 0
    while len(data) - lo > limit:
        cut = max(data.rfind(bytes([b]), lo, lo + limit) for b in BREAKS)
        if cut < 0:
            after = [at for b in BREAKS if (at := data.find(bytes([b]), lo + limit)) >= 0]
            cut = min(after, default=len(data) - 1)
        yield data[lo:cut + 1]
        lo = cut + 1
    if lo < len(data):
        yield data[lo:]


def suffixes(views: list, langs: np.ndarray, max_words: int):
    """Distinct suffixes of texts with the lang code of each text: (code,
    bytes with a space after every word, count), three sequences."""
    buf, starts = tb.joined(views)
    kind = _kind[buf]
    is_word = kind == 0
    begin = np.flatnonzero(~is_word[:-1] & is_word[1:]) + 1
    end = np.flatnonzero(is_word[:-1] & ~is_word[1:]) + 1
    n = len(begin)
    if n == 0:
        return [], [], []
    breaks = np.cumsum(kind == 2, dtype=np.int32)
    last = np.ones(n, dtype=bool)
    last[:-1] = breaks[begin[1:]] > breaks[end[:-1] - 1]
    stop = np.flatnonzero(last)
    depth = np.minimum(stop[np.searchsorted(stop, np.arange(n))] - np.arange(n) + 1, max_words)
    # the words alone, a space after each
    text = _lower[buf]
    text[end] = 32
    keep = is_word
    keep[end] = True
    text = text[keep].tobytes()
    at = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(end - begin + 1, out=at[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(at), pa.py_buffer(text)])
    coded = words.dictionary_encode()
    ids, size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary) + 1
    code = langs[np.searchsorted(starts, begin, side="right") - 1].astype(np.int64)
    key, bound = code * size + ids, len(langs) * size
    for j in range(1, max_words):
        if bound * size >= 1 << 62:
            key, found = pd.factorize(key)
            bound = len(found)
        after = np.zeros(n, dtype=np.int64)
        after[:max(n - j, 0)] = ids[j:] + 1
        key, bound = key * size + np.where(depth > j, after, 0), bound * size
    group, distinct = pd.factorize(key)
    first = np.empty(len(distinct), dtype=np.int64)
    first[group[::-1]] = np.arange(n)[::-1]
    code, lo, hi, count = code[first], at[first], at[first + depth[first]], np.bincount(group)
    del words, coded, ids, key, group, distinct, first, at, depth
    return code, [text[a:b] for a, b in zip(lo.tolist(), hi.tolist())], count


def batch_suffixes(batch: pa.RecordBatch, max_words: int):
    """(lang names, codes, phrases, counts) of each slice of a batch of (lang,
    text)."""
    coded = batch.column(0).dictionary_encode()
    names, codes = coded.dictionary.to_pylist(), coded.indices.to_pylist()
    parts = [(c, p) for c, v in zip(codes, tb.utf8_views(batch.column(1))) for p in pieces(v)]
    for lo, hi in tb.slices([p for _, p in parts], SLICE):
        yield names, *suffixes([p for _, p in parts[lo:hi]], np.array([c for c, _ in parts[lo:hi]]), max_words)


def _sample_task(max_words: int):
    def run(batches):
        for batch in batches:
            for names, code, phrase, _ in batch_suffixes(batch, max_words):
                for a in range(0, len(phrase), OUT_ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array([names[c] for c in code[a:a + OUT_ROWS]], pa.string()),
                                                      pa.array(phrase[a:a + OUT_ROWS], pa.binary())], names=["lang", "phrase"])
    return run


def _route_task(max_words: int, bounds: dict[str, list[bytes]]):
    """Messages (lang, route, phrases, counts): the suffixes of a batch that
    lie in one range, each ended by a newline, and their counts."""
    def run(batches):
        for batch in batches:
            for names, code, phrase, count in batch_suffixes(batch, max_words):
                out = []
                for c in np.unique(code):
                    own = np.flatnonzero(code == c)
                    mine = [phrase[i] for i in own.tolist()]
                    cuts = bounds.get(names[c], [])
                    route = np.fromiter((bisect_right(cuts, p) for p in mine), dtype=np.int32, count=len(mine))
                    order = np.argsort(route, kind="stable")
                    edge = np.flatnonzero(np.diff(route[order], prepend=-1, append=-1))
                    for a, b in zip(edge[:-1], edge[1:]):
                        rows = order[a:b]
                        out.append((names[c], int(route[rows[0]]), b"\n".join([mine[i] for i in rows.tolist()]) + b"\n",
                                    count[own[rows]].astype(np.int64).tobytes()))
                for a in range(0, len(out), OUT_ROWS):
                    lang, route, text, counts = zip(*out[a:a + OUT_ROWS])
                    yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(route, pa.int32()), pa.array(text, pa.binary()),
                                                      pa.array(counts, pa.binary())], names=["lang", "route", "phrases", "counts"])
    return run


def three_way(keys: np.ndarray, weight: np.ndarray, min_count: int):
    """Multikey three-way quicksort of all pointers, every segment at once.

    ``keys[d]`` holds the key of every row at depth d (-1: the row ended).
    Pointers carry the number of their segment instead of moving; in random
    order, so that a segment's last pointer is a random pivot.  Yields (row,
    depth, count): a row that begins with the prefix of depth + 1 keys, and
    the weight of all rows that do, for weights of ``min_count`` on."""
    n = keys.shape[1]
    if n == 0 or int(weight.sum()) < min_count:
        return
    row = np.random.default_rng(n).permutation(n).astype(np.int32)
    flat, weight = keys[:, row].ravel(), weight[row]
    at, seg, level = np.arange(n, dtype=np.int32), np.zeros(n, dtype=np.int32), np.zeros(1, dtype=np.int64)
    while len(at):
        key = flat[level[seg] * n + at]
        last = np.empty(len(level), dtype=np.int64)
        last[seg] = np.arange(len(seg))
        pivot = key[last]
        own = pivot[seg]
        part = 3 * seg + 1 + (key > own) - (key < own)  # less, equal, greater
        total = np.zeros(3 * len(level), dtype=np.int64)
        total += np.bincount(part, weights=weight, minlength=len(total)).astype(np.int64)
        alive = total >= min_count
        alive[1::3] &= pivot >= 0
        found = np.flatnonzero(alive[1::3])
        yield from zip(row[at[last[found]]].tolist(), level[found].tolist(), total[1::3][found].tolist())
        level = np.repeat(level, 3)
        level[1::3] += 1
        alive &= level < len(keys)
        number = (np.cumsum(alive) - 1).astype(np.int32)
        keep = alive[part]
        at, weight, seg, level = at[keep], weight[keep], number[part[keep]], level[alive]


def count_prefixes(messages: list[bytes], counts: list[bytes], min_count: int, max_words: int):
    """(phrase, words, count) of a range of suffixes: complete counts of
    ``min_count`` on, and the shares of all phrases that begin the first or the
    last suffix, whatever they count.  The empty phrase of 0 words counts all."""
    data = b"".join(messages)
    weight = np.frombuffer(b"".join(counts), dtype=np.int64)
    n = len(weight)
    off = np.zeros(n + 1, dtype=np.int64)
    off[1:] = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10) - np.arange(n)
    data = data.replace(b"\n", b"")
    at = np.concatenate([[0], np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 32) + 1])  # where words begin, and the end

    def binary(offsets):
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])

    ids = binary(at).dictionary_encode().indices.to_numpy()
    first = np.searchsorted(at, off)  # number of the first word of each row
    length = np.diff(first)
    keys = np.full((max_words, n), -1, dtype=np.int32)
    for d in range(max_words):
        has = length > d
        keys[d, has] = ids[first[:-1][has] + d]

    def named(row: int, words: int):
        lo = at[first[row]]
        return data[lo:max(lo, at[first[row] + words] - 1)], words

    phrases = binary(off)
    ends = pc.min_max(phrases)
    edges, out = {(b"", 0)}, [(b"", 0, int(weight.sum()))]
    for side in ("min", "max"):
        row = pc.index(phrases, ends[side]).as_py()
        same = np.ones(n, dtype=bool)
        for d in range(int(length[row])):
            same &= keys[d] == keys[d, row]
            if (mark := named(row, d + 1)) not in edges:
                edges.add(mark)
                out.append((*mark, int(weight[same].sum())))
    for row, d, c in three_way(keys, weight, min_count):
        if (mark := named(row, d + 1)) not in edges:
            out.append((*mark, int(c)))
    return out


def _count_task(min_count: int, max_words: int):
    def run(table):
        rows = count_prefixes(table["phrases"].to_pylist(), table["counts"].to_pylist(), min_count, max_words)
        phrase, words, count = zip(*rows)
        lang = pa.array([table["lang"][0].as_py()] * len(rows), pa.string())
        return pa.table([lang, pa.array(phrase, pa.binary()).view(pa.string()), pa.array(words, pa.int32()), pa.array(count, pa.int64())],
                        names=["lang", "phrase", "words", "f"])
    return run


def range_bounds(texts: DataFrame, size: int, parts: int, max_words: int) -> dict[str, list[bytes]]:
    """For each sampled lang the suffixes where its ranges begin (but the
    first), about ``parts`` ranges in all."""
    want = min(max(SAMPLE_LEAST, SAMPLE_PER_PART * parts), SAMPLE_ROWS)
    share = min(1.0, 1000 * want / max(size, 1))  # about 150 words for a suffix taken
    some = texts.sample(False, share, 1).mapInArrow(_sample_task(max_words), "lang string, phrase binary")
    rows = some.sample(False, min(1.0, 8 * want / max(share * size, 1)), 2).limit(4 * want).collect()
    by: dict[str, list[bytes]] = {}
    for r in rows:
        by.setdefault(r["lang"], []).append(bytes(r["phrase"]))
    out = {}
    for lang, phrases in by.items():
        phrases.sort()
        k = round(parts * len(phrases) / len(rows))
        out[lang] = sorted({phrases[i * len(phrases) // k] for i in range(1, k)})
    return out


def phrase_counts(docs: DataFrame, min_count: int = 30, max_words: int = 4) -> DataFrame:
    """(lang, phrase, words, f): every phrase of 1 to ``max_words`` words with
    f >= ``min_count``, and for each lang the empty phrase with its number of
    words."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    texts = texts.where(F.octet_length("text") > 0)
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = int(size // PART_BYTES) + 1
    bounds = range_bounds(texts, size, parts, max_words)
    sent = texts.mapInArrow(_route_task(max_words, bounds), "lang string, route int, phrases binary, counts binary")
    shares = (sent.repartition(parts, "lang", "route").groupBy("lang", "route")
              .applyInArrow(_count_task(min_count, max_words), "lang string, phrase string, words int, f long"))
    counts = shares.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where((F.col("f") >= min_count) | (F.col("words") == 0))
    return materialize(spark, counts, "phrase-counts")


def first_of(rows: DataFrame, group: str, order: list, tie: str, top: int) -> DataFrame:
    """The first ``top`` rows of each ``group`` with their rank.  Ranks within
    hashed parts of a group come first, level by level, until no group can
    hold more than 50 times ``top`` rows."""
    n, level = rows.count(), 0
    while n > 50 * top:
        parts, level = n // (50 * top) + 1, level + 1
        some = W.partitionBy(group, F.pmod(F.xxhash64(tie, F.lit(level)), F.lit(parts))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top).drop("rank")
        n = parts * top
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, min_count: int = 30, max_words: int = 4, top: int = 2000, cover_percent: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's first ``top``
    phrases by score descending, a descending, phrase ascending (bytes)."""
    spark = docs.sparkSession
    counts = phrase_counts(docs, min_count, max_words)
    known = counts.where("words > 0")
    candidates = known.where("words > 1").withColumnRenamed("f", "a")
    cuts = (candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
            .withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring_index(phrase, ' ', k - words)")))
    left = known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    score = F.expr("(2000000 * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = (cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
              .groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
              .select("lang", "phrase", "a", "c.l", "c.r", "c.score"))
    inner = F.expr("""flatten(transform(sequence(2, words - 1), m -> transform(sequence(0, words - m),
                      j -> substring_index(substring_index(phrase, ' ', j + m), ' ', -m))))""")
    covers = (candidates.where("words > 2").select("lang", "a", F.explode(inner).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    kept = (scored.join(covers, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | F.expr(f"100 * cast(longer as decimal(20,0)) < {int(cover_percent)} * cast(a as decimal(20,0))"))
            .drop("longer"))
    kept = materialize(spark, kept, "phrase-scores")
    best = first_of(kept, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], "phrase", top)
    total = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The registered query in SQL.
ORACLE_SQL = r"""
WITH t AS (SELECT COALESCE(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(COALESCE(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
s AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM w, (VALUES (1), (2), (3), (4)) v(m)),
g AS (SELECT lang, m, w[s:s + m - 1] AS p, CAST(count(*) AS HUGEINT) AS f FROM s GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, p, f AS a FROM g WHERE m > 1 AND f >= 30),
k AS (SELECT lang, m, p, a, unnest(range(1, m)) AS k FROM c),
x AS (SELECT k.*, b.f AS l, e.f AS r, (2000000 * a) // (b.f + e.f) AS score FROM k
  JOIN g b ON b.lang = k.lang AND b.p = k.p[1:k.k] JOIN g e ON e.lang = k.lang AND e.p = k.p[k.k + 1:k.m]),
y AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS i FROM x),
i AS (SELECT lang, a, p, unnest(flatten(list_transform(range(2, m), lambda z: list_transform(range(1, m - z + 2), lambda j: p[j:j + z - 1])))) AS q FROM c WHERE m > 2),
d AS (SELECT lang, q, max(a) AS longer FROM i GROUP BY ALL),
z AS (SELECT y.lang, array_to_string(y.p, ' ') AS phrase, y.a, l, r, score FROM y LEFT JOIN d ON d.lang = y.lang AND d.q = y.p
  WHERE i = 1 AND (longer IS NULL OR 100 * longer < 80 * y.a)),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM o JOIN n USING (lang) WHERE rank <= 2000"""
