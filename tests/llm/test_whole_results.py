"""Cases in which rows, columns, digits or budgets used to be cut."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lendscope.llm import langid, line_dedup, mixing, neardup, topk

from .conftest import SF, rows, table
from .test_dedup import union_find


# ---------------------------------------------------------------- op3
def test_topk_of_large_components_is_exact(spark):
    got = topk.search(spark.createDataFrame([(0, [1e6]), (100, [1e6]), (7, [2e6])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 10)
    assert rows(got) == [(0, 1, 7, 2 * 1024 ** 2 * 10 ** 12), (0, 2, 100, 1024 ** 2 * 10 ** 12)]
    rng = random.Random(3)
    data = [(i, [float(rng.randint(-10 ** 6, 10 ** 6)) for _ in range(6)]) for i in range(60)]
    got = topk.search(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, 5)
    ints = {i: [int(1024 * x) for x in v] for i, v in data}
    want = []
    for q in range(0, 60, 10):
        all_of = sorted((-sum(a * b for a, b in zip(ints[q], ints[c])), c) for c in ints if c != q)[:5]
        want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(all_of)]
    assert max(abs(w[3]) for w in want) > 2 ** 57
    assert sorted(tuple(r) for r in got.collect()) == want


def test_topk_beyond_64_bits_is_an_error(spark):
    for big in (1e10, 1e20):
        df = spark.createDataFrame([(0, [big]), (1, [big])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="64 bits"):
            topk.search(df, F.col("vec_id") == 0, 1).collect()


# ---------------------------------------------------------------- op4
def taken(spark, docs, budget, epochs=1):
    df = table(spark, docs).withColumn("domain", mixing.domain_of(F.col("source")))
    return mixing.mix(df, mixing.LEVELS, mixing.WEIGHTS, F.lit(budget), epochs, 17).collect()


@pytest.mark.parametrize("ids", ["null", "shared", "mixed"])
@pytest.mark.parametrize("budget", [5, 15, 33, 1000])
def test_mix_never_passes_the_budget(spark, ids, budget):
    name = {"null": lambda i: None, "shared": lambda i: 7, "mixed": lambda i: [None, 3, i][i % 3]}[ids]
    text = lambda i: " ".join(f"w{i % 4 if i < 6 else i}" for _ in range(10))
    docs = [(name(i), text(i), "en", "src0") for i in range(12)]
    got = taken(spark, docs, budget)
    assert sum(r["tokens_taken"] for r in got) == min(budget, 120)
    assert all(0 < r["tokens_taken"] <= r["n_tokens"] for r in got) and sum(r["tokens_taken"] < r["n_tokens"] for r in got) <= 1
    assert not Counter((r["doc_id"], r["text"]) for r in got) - Counter((i, t) for i, t, *_ in docs)


def test_mix_with_shared_ids_equals_its_sql(spark):
    rng = random.Random(5)
    docs = []
    for i in range(240):
        words = " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(1, 30)))
        docs.append((rng.choice([None, None, 5, i]), rng.choice([words, "the same text for many"]), rng.choice(["en", "de", None]), f"src{rng.randrange(3)}"))
    df = table(spark, docs).withColumn("domain", mixing.domain_of(F.col("source")))
    con = duckdb.connect()
    documents = df.select("doc_id", "text", "lang", "source").toPandas()  # noqa: F841
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    con.sql("CREATE TABLE documents AS SELECT * FROM documents")
    for percent, epochs in ((60, 2), (37, 1), (130, 2)):
        got = mixing.mix(df, mixing.LEVELS, mixing.WEIGHTS, F.expr(f"(supply * {percent}) div 100"), epochs, 17)
        got = sorted((tuple(r) for r in got.select("doc_id", "domain", "lang", "source", "epoch", "n_tokens", "tokens_taken").collect()), key=str)
        assert got == sorted(con.sql(mixing.oracle_sql(percent, epochs, 17)).fetchall(), key=str)


# ---------------------------------------------------------------- op8
def test_blank_lines_are_no_passage(spark):
    docs = [(1, "one\n\n\ntwo", "en", None), (2, "three\n\n\nfour", "en", None), (3, " \n\t\nfive\n \n\t\nsix", "en", None),
            (4, "seven\nshared a\n\n\nshared b\neight", "en", None), (5, "nine\nshared a\n\n\nshared b\nten", "en", None)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_runs(table(spark, docs)).collect()}
    assert got == {**{i: t for i, t, *_ in docs}, 5: "nine\nten"}


# ---------------------------------------------------------------- op6
@pytest.mark.parametrize("dim", [1, 2, 3, 4, 8, 16, 64])
def test_links_in_every_dimension(spark, dim):
    rng = np.random.default_rng(dim)
    v = rng.normal(size=(160, dim))
    near = v + 0.3 * np.linalg.norm(v, axis=1, keepdims=True) * rng.normal(size=v.shape) / np.sqrt(dim)
    x = np.concatenate([v, near])
    labels = ["a" if i % 3 else None if i % 2 else "b" for i in range(len(x))]
    data = [(i, [float(c) for c in e], la) for i, (e, la) in enumerate(zip(x, labels))] + [(900, [1.0] * (dim + 1), "a")]
    got = neardup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>, label string"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = [(i, j) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.93, 1))) if labels[i] is not None and labels[i] == labels[j]]
    want = Counter(i for e in links for i in e)
    have = {r["vec_id"]: r["n_links"] for r in got.collect()}
    assert set(have) == {d[0] for d in data} and all(n <= want[i] for i, n in have.items())
    assert sum(have.values()) >= (1.0 if dim < neardup.LEAST_DIM else 0.9) * sum(want.values()) > 0
    if dim < neardup.LEAST_DIM:
        comp = union_find(range(len(x)), links)
        assert {r["vec_id"]: r["component_id"] for r in got.collect()} == {**comp, 900: 900}


# ---------------------------------------------------------------- op1
def test_language_without_spaces_is_learnt(spark):
    rng = random.Random(1)
    zh = ["".join(rng.choice("的一是不了人我在有他这中大来上国") for _ in range(24_000)) for _ in range(6)]
    en = [" ".join(rng.choice("the of and to in is was that for it with as his on be at by had".split()) for _ in range(80)) for _ in range(12)]
    docs = table(spark, [(i, t, "zh", None) for i, t in enumerate(zh)] + [(50 + i, t, "en", None) for i, t in enumerate(en)] + [(90, "a", "tiny", None)])
    made = langid.fit(docs, F.lit(True))
    assert set(made) == {"zh", "en", "tiny"} and all(len(v) >= 8 for v in made.values())
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, made).collect()}
    assert all(got[i] == "zh" for i in range(6)) and all(got[50 + i] == "en" for i in range(12))


def test_language_equals_brute_force(spark, sample):
    import zstandard as z

    docs = sample.select("doc_id", "text", "lang")
    made = langid.fit(docs, F.col("doc_id") % 2 == 0)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, made).collect()}
    assert len(got) == docs.count()
    for r in docs.limit(80).collect():
        text = (r["text"] or "").lower()
        if not any(c.isalpha() for c in text):
            assert got[r["doc_id"]] == ("und", 0.0)
            continue
        size = []
        for lang, data in made.items():
            c = z.ZstdCompressor(level=langid.LEVEL, dict_data=z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT),
                                 write_checksum=False, write_content_size=False, write_dict_id=False)
            raw = text.encode()
            size.append((sum(len(c.compress(raw[i:i + langid.SEGMENT])) for i in range(0, len(raw), langid.SEGMENT)), lang))
        size.sort()
        margin = size[1][0] / size[0][0] - 1
        assert got[r["doc_id"]] == (size[0][1], pytest.approx(margin / (margin + 0.02)))


# ---------------------------------------------------------------- pipeline
def test_stages_keep_values_of_clashing_columns(spark, sample):
    clash = ["score", "predicted", "n_removed", "epoch", "n_tokens", "tokens_taken", "domain", "row", "__row", "id"]
    docs = sample
    for c in clash:
        docs = docs.withColumn(c, F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        bad = F.lit(False)
        for c in clash:
            bad = bad | (F.col(c) != F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")))
        assert got.count() > 0 and got.where(bad).count() == 0, name


def test_different_texts_under_one_id_stay(spark):
    text = lambda k: " ".join(hashlib.md5(f"{k}-{j}".encode()).hexdigest()[:6] for j in range(40))
    docs = table(spark, [(7, text(1), "en", None), (7, text(2), "en", None), (None, text(3), "en", None), (None, text(4), "de", None),
                         (8, text(1), "en", None), (None, text(3), "en", None), (9, None, "en", None), (9, "", "en", None)])
    got = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert Counter(r["text"] for r in got.collect()) == Counter([text(1), text(2), text(3), text(4), None, ""])
