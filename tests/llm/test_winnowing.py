"""Benchmark decontamination: brute force over random texts, short items,
shared passages, awkward rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lendscope.llm import winnowing

from .conftest import rows


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(docs, items, window=10):
    """(doc_id, n_words, n_hit, items, spans) of every row."""
    at = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if n else 0):
            at.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in {len(k) for k in at}:
            for i in range(len(w) - n + 1):
                if (who := at.get(tuple(w[i:i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= who
        spans = [[p, p] for p in sorted(hit) if p - 1 not in hit]
        for s in spans:
            while s[1] + 1 in hit:
                s[1] += 1
        out.append((doc, len(w), len(hit), sorted(str(x) for x in found if x is not None), [tuple(s) for s in spans]))
    return sorted(out, key=str)


def found(spark, docs, items, window=10):
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = winnowing.decontaminate(d, b, window, {"items": F.col("items")})
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"] or []), [tuple(s) for s in r["spans"]])
                   for r in got.docs.collect()), key=str)


def random_corpus(seed, n_docs=120, n_items=40, shortest=1, vocabulary=12):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(vocabulary * 10)] + ["É", "é", "漢字", "X9"]

    def text(n):
        return rng.choice([" ", ", ", "-"]).join(rng.choice(vocab) for _ in range(n))
    items = [(i if rng.random() < 0.9 else None, text(rng.randint(shortest, 30))) for i in range(n_items)]
    items += [(3, items[5][1]), (77, items[4][1]), (78, ""), (79, None), (80, " .,; ")]
    docs = []
    for i in range(n_docs):
        parts = [text(rng.randint(0, 20))]
        for _ in range(rng.randint(0, 3)):
            w = rng.choice(items)[1] or ""
            w = words(w)
            lo = rng.randint(0, len(w))
            parts += [" ".join(w[lo:lo + rng.randint(1, 30)]).upper(), text(rng.randint(0, 5))]
        docs.append((i if rng.random() < 0.9 else rng.choice([None, 1]), " ".join(parts)))
    return docs + [(None, None), (500, ""), (501, " ?! "), docs[0], docs[0]], items


@pytest.mark.parametrize("seed,shortest", [(1, 1), (2, 4), (3, 10)])
def test_equals_brute_force(spark, seed, shortest):
    docs, items = random_corpus(seed, shortest=shortest)
    want = brute(docs, items)
    assert any(r[2] for r in want) and any(not r[2] for r in want)
    assert found(spark, docs, items) == want


def test_every_length_of_window_is_found_alone(spark):
    docs = [(n, " ".join(["x"] * 3 + [f"a{j}" for j in range(n)] + ["y"] * 3)) for n in range(1, 16)]
    items = [(n, " ".join(f"a{j}" for j in range(n))) for n in (2, 5, 7, 9, 13)]
    for n, text in items:
        one = [(n, text)]
        assert found(spark, docs, one) == brute(docs, one)
    assert found(spark, docs, items, 6) == brute(docs, items, 6)


def test_a_span_of_nine_words_is_no_hit_and_ten_are(spark):
    item = [f"i{j}" for j in range(40)]
    docs = [(lo * 100 + n, " ".join(["q", *item[lo:lo + n], "q"])) for lo in range(0, 28) for n in (9, 10, 11)]
    got = found(spark, docs, [(1, " ".join(item))])
    assert got == brute(docs, [(1, " ".join(item))])
    assert all((r[2] >= 10) == (r[0] % 100 >= 10) for r in got)


def test_hot_passage_lists_its_items_once(spark):
    passage = " ".join(f"p{j}" for j in range(30))
    items = [(i, f"own{i} {passage}") for i in range(200)]
    docs = [(i, f"d{i} {passage} e{i}") for i in range(300)]
    got = winnowing.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"),
                                  spark.createDataFrame(items, "item_id long, text string"))
    assert got.items.count() == 1 and len(got.items.first()["items"]) == 200
    assert got.docs.where("n_hit = 30").count() == 300


def test_awkward_and_empty(spark, awkward, empty):
    bench = spark.createDataFrame([(1, "same text twice", "z"), (2, " ".join(f"word{i}" for i in range(100, 130)), "z")],
                                  "item_id long, text string, n_hit string")
    got = winnowing.decontaminate(awkward, bench).docs
    assert set(awkward.columns) <= set(got.columns) and got.count() == awkward.count()
    hits = {(r["doc_id"], r["n_hit"]) for r in got.where("n_hit > 0").collect()}
    assert hits == {(4, 31 * 30), (5, 3), (6, 3)}
    assert winnowing.decontaminate(empty, bench).docs.count() == 0
    none = winnowing.decontaminate(awkward, bench.where("false"))
    assert none.docs.where("n_hit > 0 or size(spans) > 0 or item_set is not null").count() == 0 and none.items.count() == 0
    clash = awkward.withColumn("n_hit", F.lit("x")).withColumn("row", F.lit("x")).withColumn("s", F.lit(1))
    assert rows(winnowing.decontaminate(clash, bench).docs, "row", "s") == rows(clash, "row", "s")


def test_scheme_never_asks_for_more_than_a_window():
    for n in range(1, 40):
        (k, w), = winnowing.scheme([n])
        assert k >= 1 and w >= 1 and k + w - 1 == n
    for k, w in winnowing.scheme(list(range(1, 20))):
        assert all(k + w - 1 <= n for n in range(1, 20) if max(min(n, 3), (n + 1) // 2) == k)


def test_query_digests(spark, tmp_path):
    from lendscope.llm.queries import QUERIES

    docs, items = random_corpus(9)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((tuple(r) for r in QUERIES["op12_winnowing"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0)
                          for d, n, h, i, _ in brute(docs, items)), key=str)
