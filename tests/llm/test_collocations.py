"""Phrase collocations: brute force over random texts and partitions, the
quicksort alone, hot passages, awkward rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendscope.llm import collocations as co

from .conftest import LONG, rows, table


def text_pieces(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for p in re.split(r"[.,;:!?\x0A-\x0D]", text) if (w := re.findall(r"[^\x20\x09]+", p))]


def brute_counts(docs, max_words=4):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for w in text_pieces(text):
            n[lang] += len(w)
            for m in range(1, max_words + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i:i + m])] += 1
    return f, n


def brute(docs, min_count, top, max_words=4, cover=80):
    f, n = brute_counts(docs, max_words)
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    longer = {}
    for (lang, p), a in cand.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                longer[lang, p[i:i + m]] = max(a, longer.get((lang, p[i:i + m]), 0))
    by = {}
    for (lang, p), a in cand.items():
        if 100 * longer.get((lang, p), 0) >= cover * a:
            continue
        score, _, x, y = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        by.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), x, y))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, got in by.items() for i, (s, a, p, x, y) in enumerate(sorted(got)[:top]))


def corpus(seed, n_docs=150, vocabulary=14):
    rng = random.Random(seed)
    vocab = ["The", "a", "é", "É", "漢", "x\x01", "x", "x-y", "b\x00"] + [f"w{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(len(vocab))]

    def text():
        out = []
        for _ in range(rng.randint(0, 60)):
            out.append(rng.choices(vocab, weights)[0])
            out.append(rng.choices([" ", "  ", "\t", ". ", ",", "\n", " \r\n", "!?"], [20, 1, 1, 2, 1, 1, 1, 1])[0])
        return "".join(out)
    docs = [(rng.choice(["en", "en", "en", "de", None]), text()) for _ in range(n_docs)]
    return docs + [("en", None), ("fr", ""), (None, " .. ,"), ("und", "the a the a"), docs[0], docs[0]]


def mined(spark, docs, **kw):
    got = co.collocations(spark.createDataFrame(docs, "lang string, text string"), **kw)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("seed,part_bytes,slice_bytes", [(1, 8 << 20, 4 << 20), (2, 900, 300), (3, 200, 64)])
def test_equals_brute_force(spark, monkeypatch, seed, part_bytes, slice_bytes):
    monkeypatch.setattr(co, "PART_BYTES", part_bytes)
    monkeypatch.setattr(co, "SLICE", slice_bytes)
    docs = corpus(seed)
    want = brute(docs, 8, 25)
    assert len(want) > 30
    assert mined(spark, docs, min_count=8, top=25) == want


def test_other_lengths_and_covers(spark):
    docs = corpus(7)
    for m, cover in ((2, 80), (3, 50), (5, 100)):
        assert mined(spark, docs, min_count=6, max_words=m, top=40, cover_percent=cover) == brute(docs, 6, 40, m, cover)


def test_quicksort_counts_every_heavy_prefix():
    rng = np.random.default_rng(5)
    for n, values, least in ((1, 1, 1), (500, 3, 1), (4000, 12, 25), (4000, 200, 10)):
        keys = rng.zipf(1.3, size=(5, n)).clip(max=values).astype(np.int32)
        ended = rng.integers(1, 6, n)
        keys[np.arange(5)[:, None] >= ended[None, :]] = -1
        weight = rng.integers(1, 4, n)
        want = Counter()
        for row in range(n):
            for d in range(int(ended[row])):
                want[tuple(keys[:d + 1, row])] += int(weight[row])
        got = [(tuple(keys[:d + 1, row]), c) for row, d, c in co.three_way(keys, weight, least)]
        assert len(got) == len(dict(got)) and dict(got) == {k: c for k, c in want.items() if c >= least}


def test_shares_of_neighbouring_ranges_add_up():
    """Any cut of the sorted suffixes gives the same sums."""
    docs = [t for _, t in corpus(4)]
    f, n = brute_counts([("x", t) for t in docs])
    every = Counter()
    for t in docs:
        for w in text_pieces(t):
            for i in range(len(w)):
                every["".join(x + " " for x in w[i:i + 4]).encode()] += 1
    order = sorted(every)
    for step in (1, 7, 50, len(order)):
        total = Counter()
        for lo in range(0, len(order), step):
            part = order[lo:lo + step]
            random.Random(lo).shuffle(part)
            half = len(part) // 2 + 1
            cut = [p for p in (part[:half], part[half:]) if p]
            got = co.count_prefixes([b"".join(x + b"\n" for x in p) for p in cut],
                                    [np.array([every[x] for x in p], dtype=np.int64).tobytes() for p in cut], 9, 4)
            assert len({(p, m) for p, m, _ in got}) == len(got)
            for phrase, words, c in got:
                total[tuple(phrase.decode().split(" ")) if words else ()] += c
        assert total.pop(()) == n["x"]
        assert {k: c for k, c in total.items() if c >= 9} == {k[1]: c for k, c in f.items() if c >= 9}


def test_first_of_in_levels(spark):
    n = 3000
    df = spark.range(n).selectExpr("'g' as g", "cast(id % 50 as int) as s", "cast(id as string) as t")
    got = co.first_of(df, "g", [F.desc("s"), F.asc("t")], "t", 7).orderBy("rank").collect()
    want = sorted(((-(i % 50), str(i)) for i in range(n)))[:7]
    assert [(r["rank"], -r["s"], r["t"]) for r in got] == [(i + 1, *w) for i, w in enumerate(want)]


def test_long_texts_are_cut_between_pieces():
    text = ("ab cd " * 50 + ", " + "x" * 300 + " y. ").encode() * 5 + b"no end"
    got = list(co.pieces(memoryview(text), 64))
    assert b"".join(bytes(p) for p in got) == text and len(got) > 5
    assert all(bytes(p)[-1:] in (b",", b".") for p in got[:-1])


def test_hot_passage_is_sent_once_a_batch(spark):
    passage = "every third row has this passage in it"
    docs = spark.createDataFrame([("en", passage)] * 3000 + [("en", f"own{i} words{i}") for i in range(300)], "lang string, text string").coalesce(2)
    sent = docs.mapInArrow(co._route_task(4, {"en": [b"f"]}), "lang string, route int, phrases binary, counts binary").collect()
    assert {r["route"] for r in sent} == {0, 1} and len(sent) <= 4
    assert sum(bytes(r["phrases"]).count(b"every third row has \n") for r in sent) <= 2
    assert sum(np.frombuffer(r["counts"], dtype=np.int64).sum() for r in sent) == 3000 * 8 + 600
    got = {r["phrase"]: (r["a"], r["score"]) for r in co.collocations(docs).collect()}
    assert got["every third row has"] == (3000, 1000000) and "every third" not in got


def test_large_counts_do_not_overflow(spark):
    counts = spark.createDataFrame([("en", "x", 1, 9 * 10**18), ("en", "x x", 2, 8 * 10**18)], "lang string, phrase string, words int, f long")
    got = counts.selectExpr("(2000000 * cast(f as decimal(20,0))) div (cast(f as decimal(20,0)) + cast(f as decimal(20,0))) as s")
    assert [r["s"] for r in got.collect()] == [1000000, 1000000]


def test_awkward_and_empty(spark, awkward, empty):
    assert co.collocations(empty).collect() == []
    got = co.collocations(table(spark, [(1, LONG, "en", None), (2, "same text twice", None, None), (2, "same text twice", "und", None)])
                          .withColumn("phrase", F.lit(1)).withColumn("count", F.lit(1)), min_count=2, top=3)
    assert rows(got.where("lang = 'und'"), "phrase", "a", "score", "n") == [("same text twice", 2, 1000000, 6)]
    assert got.where("lang = 'en'").count() == 3
    assert co.collocations(awkward.drop("doc_id"), min_count=2).count() > 0
