"""Language id, LM scoring, toxicity, quality: held-out accuracy, brute-force
versions and awkward rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendscope.llm import langid, lm_scoring, quality, textbuf, toxicity
from lendscope.llm.common import held_out, labelled_sample

from .conftest import LONG, SF, table

MID = "/root/testdata/sf0.1"


def test_held_out_is_crc32(spark):
    got = {r[0]: r[1] for r in spark.range(200).select("id", held_out(F.col("id"), 3, 1)).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(200)}


def test_labelled_sample_is_bounded_and_unambiguous(spark):
    docs = table(spark, [(i, f"text {i}", "en", "s") for i in range(3000)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(3000)] + [(1, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = labelled_sample(docs, labels, "quality", F.lit(True), 200).collect()
    count = Counter(r["y"] for r in got)
    assert 120 < count[0] < 280 and 120 < count[1] < 280 and all(r["doc_id"] != 1 for r in got)


def test_language_id_accuracy_on_held_out(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    out = held_out(F.col("doc_id"), 3, 1)
    got = langid.predict(docs, langid.fit(docs, ~out), carry=["doc_id", "lang"]).where(out)
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_language_id_awkward(spark, awkward, empty, sample):
    dictionaries = langid.fit(sample, F.lit(True))
    got = {(r["doc_id"], r["text"]): r for r in langid.predict(awkward, dictionaries).collect()}
    assert len(got) == 9  # the repeated row gets one result
    for key in ((1, None), (2, ""), (3, "   \n\t\n "), (7, "123 !!! ???")):
        assert (got[key]["lang_pred"], got[key]["score"], got[key]["accepted"]) == ("und", 0.0, False)
    assert all(r["lang_pred"] in dictionaries for k, r in got.items() if k[0] in (4, 5, 6, 8))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.predict(empty, dictionaries).count() == 0
    assert langid.fit(empty, F.lit(True)) == {}
    assert {r["lang_pred"] for r in langid.predict(awkward, {}).collect()} == {"und"}


def test_compressed_sizes_cover_the_whole_text():
    made = langid._compressors({"a": b"alpha beta gamma " * 20, "b": b"delta epsilon zeta " * 20})
    text = ("alpha beta gamma " * 2000).encode()
    whole = langid.compressed_sizes(made, text)
    by_part = sum(langid.compressed_sizes(made, text[i:i + langid.SEGMENT]) for i in range(0, len(text), langid.SEGMENT))
    assert (whole == by_part).all() and whole[0] < whole[1]


def brute_fm(model, slots, weights):
    """All pairwise interactions spelt out."""
    z = model.bias + sum(model.linear[s] * x for s, x in zip(slots, weights))
    for i in range(len(slots)):
        for j in range(i + 1, len(slots)):
            z += float(model.factors[slots[i]] @ model.factors[slots[j]]) * weights[i] * weights[j]
    return z


def test_factorisation_machine_equals_all_pairs():
    rng = np.random.default_rng(0)
    model = quality.Model(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, quality.RANK)) * 0.3)
    views = [b"one two two THREE!! four", b"", b"a b c d e f\nlast line here 12 34"]
    doc, slot, weight, dense = quality.features(views, np.array([24.0, np.nan, 30.0]))
    fast = quality.scores(model, doc, slot, weight, dense)
    for i in range(3):
        s = np.concatenate([slot[doc == i], np.arange(quality.WORD_SPACE, quality.SIZE)])
        x = np.concatenate([weight[doc == i], dense[i]])
        assert fast[i] == pytest.approx(brute_fm(model, s, x), rel=1e-9)


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{MID}/documents.parquet"), spark.read.parquet(f"{MID}/labels.parquet")
    out = held_out(F.col("doc_id"), 5, 0)
    model = quality.fit(docs, labels, ~out)
    got = quality.score(docs, model, 0.3, carry=["doc_id"]).join(labels, "doc_id").where(out)
    right = {r["quality"]: r["a"] for r in got.groupBy("quality").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("a")).collect()}
    assert right[1] > 0.97 and right[0] > 0.9


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{MID}/documents.parquet"), spark.read.parquet(f"{MID}/labels.parquet")
    out = held_out(F.col("doc_id"), 3, 1)
    model = toxicity.fit(docs, labels, ~out)
    got = toxicity.score(docs, model, 0.7, carry=["doc_id"]).join(labels, "doc_id").where(out)
    flagged = {r["toxic"]: r["a"] for r in got.groupBy("toxic").agg(F.avg("predicted").alias("a")).collect()}
    assert flagged[1] > 0.75 and flagged[0] < 0.03


def test_toxicity_shares_subwords_with_misspellings():
    clean = [(0, f"plain words number {i} about gardens and rivers") for i in range(60)]
    bad = [(1, f"plain words number {i} you horrible scoundrel there") for i in range(60)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in clean + bad]), pa.array([y for y, _ in clean + bad], pa.int32())], names=["text", "y"])
    got = next(toxicity._sample([batch])).to_pydict()
    model = toxicity.fit_rows([(y, np.frombuffer(i, np.uint16), np.frombuffer(s, np.int32)) for y, i, s in zip(got["y"], got["ids"], got["sizes"])])
    odds = toxicity.log_odds(model, [b"plain gardens and rivers", b"a horribble scoundrell came", b""])
    assert odds[1] > 0.5 and odds[0] < -0.5 and odds[2] == model.bias


def test_run_log_odds_equal_brute_force():
    rng = np.random.default_rng(3)
    model = toxicity.Model(0.2, rng.normal(size=toxicity.BUCKETS))
    text = "The quick brown fox — jumps über the lazy dog, twice over again ok"
    words, at = [], ""
    for c in text.lower() + " ":
        if c.isalnum():
            at += c
        elif at:
            words.append(at)
            at = ""

    def grams(w):
        cp = np.array([0, *[ord(c) for c in w], 0], dtype=np.uint64)
        value = textbuf.mix(cp + textbuf.U64(1))
        p, out = 0x9E3779B97F4A7C15, []
        for n in range(toxicity.SHORTEST, toxicity.LONGEST + 1):
            for i in range(len(cp) - n + 1):
                h = sum(int(value[i + k]) * pow(p, k, 1 << 64) for k in range(n)) % (1 << 64)
                out.append(int(textbuf.mix(np.array([(h + n) % (1 << 64)], np.uint64))[0]) % toxicity.BUCKETS)
        return out

    best = -math.inf
    for lo in range(0, len(words), toxicity.WINDOW):
        ids = [g for w in words[lo:lo + toxicity.WINDOW] for g in grams(w)]
        best = max(best, float(np.mean(model.table[ids])) + model.bias if ids else model.bias)
    assert toxicity.log_odds(model, [text.encode()])[0] == pytest.approx(best, rel=1e-9)


@pytest.mark.parametrize("op", [quality, toxicity])
def test_classifiers_awkward(spark, op, awkward, empty, sample, labels):
    model = op.fit(sample, labels, F.lit(True))
    got = op.score(awkward, model).collect()
    assert len(got) == awkward.count() and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 5}) == 1
    assert op.score(empty, model).count() == 0
    nothing = labels.where("false")
    assert 0 <= op.score(awkward, op.fit(sample, nothing, F.lit(True))).first()["score"] <= 1
    one = labels.where("quality = 1 and toxic = 0")
    assert all(0 <= r["score"] <= 1 for r in op.score(awkward, op.fit(sample, one, F.lit(True))).collect())


def brute_lm(texts, marks):
    """Counts in dictionaries over the same slots, losses word by word."""
    def tokens(t):
        word, before, pair, _ = lm_scoring.slots([t.encode()])
        return list(zip(word.tolist(), before.tolist(), pair.tolist()))
    uni, ctx, bi, n = [Counter(), Counter()], [Counter(), Counter()], [Counter(), Counter()], [0, 0]
    for t, m in zip(texts, marks):
        for k in (0, 1):
            if k or m:
                for w, v, p in tokens(t):
                    uni[k][w] += 1
                    ctx[k][v] += v == lm_scoring.VOCABULARY
                    bi[k][p] += 1
                    n[k] += 1
    scale = [1.0, n[0] / n[1]]
    out = []
    for t in texts:
        total = [0.0, 0.0]
        for w, v, p in tokens(t):
            for k in (0, 1):
                c = lambda x: (uni[k][x] if x < lm_scoring.VOCABULARY else ctx[k][x]) * scale[k]  # noqa: B023, E731
                one = (c(w) + lm_scoring.ADD) / (n[k] * scale[k] + lm_scoring.ADD * lm_scoring.VOCABULARY)
                total[k] -= math.log((bi[k][p] * scale[k] + lm_scoring.PRIOR * one) / (c(v) + lm_scoring.PRIOR))
        m = len(tokens(t))
        out.append((m, total[0] / m - total[1] / m) if m else (0, None))
    return out


def test_lm_scores_equal_brute_force(spark, sample):
    part = [(r["doc_id"], r["text"]) for r in sample.orderBy("doc_id").limit(40).collect()] + [(900, ""), (901, "solo")]
    docs = table(spark, [(i, t, "en", "s") for i, t in part])
    count = lm_scoring.counts(docs, F.col("doc_id") % 2 == 0)
    got = {r["doc_id"]: (r["n_tokens"], r["score"]) for r in lm_scoring.score(docs, count, carry=["doc_id"]).collect()}
    for (i, _), want in zip(part, brute_lm([t for _, t in part], [i % 2 == 0 for i, _ in part])):
        assert got[i][0] == want[0]
        assert got[i][1] is None if want[1] is None else got[i][1] == pytest.approx(want[1], abs=1e-3)


def test_lm_awkward(spark, awkward, empty):
    count = lm_scoring.counts(awkward, F.lit(None).cast("boolean"))
    got = lm_scoring.score(awkward, count).collect()
    assert len(got) == awkward.count()
    assert {r["doc_id"] for r in got if r["score"] is None} == {1, 2, 3}
    assert lm_scoring.score(empty, lm_scoring.counts(empty, F.lit(True))).count() == 0


def exact_lm(texts, marks):
    """Scores by dictionaries of the n-grams themselves."""
    def tokens(t):
        w = re.findall(r"[^ \t\n\v\f\r]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        return list(zip([None, *w], w))
    uni, bi, start = [Counter(), Counter()], [Counter(), Counter()], [0, 0]
    split = [tokens(t) for t in texts]
    for x, m in zip(split, marks):
        for k in (0, 1):
            if x and (k or m):
                uni[k].update(w for _, w in x)
                bi[k].update(x)
                start[k] += 1
    n = [sum(u.values()) for u in uni]
    scale = [1.0, n[0] / n[1] if n[0] and n[1] else 1.0]
    out = []
    for x in split:
        total = [0.0, 0.0]
        for v, w in x:
            for k in (0, 1):
                one = (uni[k][w] * scale[k] + lm_scoring.ADD) / (n[k] * scale[k] + lm_scoring.ADD * len(uni[1]))
                c = (start[k] if v is None else uni[k][v]) * scale[k]
                total[k] -= math.log((bi[k][v, w] * scale[k] + lm_scoring.PRIOR * one) / (c + lm_scoring.PRIOR))
        out.append((len(x), total[0] / len(x), total[1] / len(x)) if x else (0, None, None))
    return out, len(bi[1])


def test_lm_scores_are_those_of_the_n_grams(spark, tmp_path, monkeypatch):
    """The query against dictionaries, with far more bigrams than 2^20 and
    many batches and parts."""
    from lendscope.llm.queries import QUERIES

    monkeypatch.setattr(lm_scoring, "BATCH_TEXT", 1 << 20)
    monkeypatch.setattr(lm_scoring, "PART_TEXT", 1 << 17)
    rng = np.random.default_rng(22)
    docs = [(i, " ".join(f"W{x}" for x in (rng.zipf(1.3, 9000) % 10**7 if i % 2 else rng.integers(0, 60_000, 9000)))) for i in range(300)]
    docs += [(900, ""), (901, "solo"), (902, None), (903, " \n"), (904, "never seen\tBefore é")]
    table(spark, [(i, t, "en", "s") for i, t in docs]).select("doc_id", "text").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 == 0), 0) for i, _ in docs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want, bigrams = exact_lm([t for _, t in docs], [i % 3 == 0 for i, _ in docs])
    assert bigrams > 1.3 * 2**20
    got = {r["doc_id"]: r for r in QUERIES["op2_lm_scoring"](spark, str(tmp_path)).collect()}
    assert len(got) == len(docs)
    for (i, _), (n, a, b) in zip(docs, want):
        assert got[i]["n_tokens"] == n
        if n:
            assert (got[i]["ce_target"], got[i]["ce_background"]) == pytest.approx((a, b), abs=1e-9)
            assert got[i]["score"] == pytest.approx(a - b, abs=1e-9) and a > 0 and b > 0
        else:
            assert got[i]["score"] is None and got[i]["ce_target"] is None


def test_exact_lm_awkward(spark, awkward, empty):
    got = lm_scoring.score_grams(awkward, F.lit(None).cast("boolean"))
    assert got.columns == [c for c in awkward.columns if c != "score"] + ["n_tokens", "ce_target", "ce_background", "score"]
    by = {(r["doc_id"], r["text"]): r for r in got.collect()}
    assert got.count() == awkward.count() and {k[0] for k, r in by.items() if r["score"] is None} == {1, 2, 3}
    texts = [r["text"] for r in awkward.collect()]
    for t, (n, a, b) in zip(texts, exact_lm(texts, [False] * len(texts))[0]):
        r = next(r for k, r in by.items() if k[1] == t)
        assert r["n_tokens"] == n and (r["ce_target"], r["ce_background"]) == ((None, None) if not n else pytest.approx((a, b), abs=1e-9))
    assert lm_scoring.score_grams(empty, F.lit(True)).count() == 0


def test_word_and_shingle_hashes():
    a, off = textbuf.shingle_sets([b"One TWO three four", b"x\tone two\nthree  four", b"one two", b"", b"one two three"], 4)
    sets = [set(a[off[i]:off[i + 1]].tolist()) for i in range(5)]
    assert sets[0] < sets[1] and len(sets[1]) == 2 and sets[3] == set() and len(sets[2]) == len(sets[4]) == 1 and sets[2] != sets[4]
    long, off = textbuf.shingle_sets([LONG.encode()], 5)
    assert len(long) == 977


def test_queries_cover_the_table(spark):
    from lendscope.llm.queries import QUERIES

    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name, cols in (("op1_language_id", ["doc_id", "held_out", "lang_pred", "score"]), ("op2_lm_scoring", ["doc_id", "score"]),
                       ("op7_toxicity", ["doc_id", "held_out", "score", "predicted"]), ("op9_quality", ["doc_id", "held_out", "score", "predicted"])):
        df = QUERIES[name](spark, SF)
        assert df.count() == n and set(cols) <= set(df.columns)
