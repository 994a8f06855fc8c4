"""Mixing and packing: SQL oracle, brute-force versions, hot groups and
awkward rows; the pipeline; the registration guard."""

import hashlib
import os
import random
import subprocess
import sys
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lendscope.llm import mixing, packing
from lendscope.llm.queries import ORACLE, QUERIES

from .conftest import SF, rows, table

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def words(n, tag="w"):
    return " ".join(f"{tag}{i}" for i in range(n))


def fill(budget, children):
    """Water-filling in whole numbers: {name: (cap, weight)} -> {name: alloc}."""
    out, left, weight = {}, budget, sum(w for _, w in children.values())
    todo = sorted(children, key=lambda n: (children[n][0] / children[n][1], n is not None, n))
    for i, name in enumerate(todo):
        cap, w = children[name]
        if w * left >= cap * weight:
            out[name], left, weight = cap, left - cap, weight - w
        else:
            return out | {n: left * children[n][1] // weight for n in todo[i:]}
    return out


def brute_mix(docs, weights, percent, epochs, seed):
    """docs: (id, n, domain, lang, source) -> rows (id, epoch, taken)."""
    def w(level, v):
        return weights.get(level, {}).get(v, 1)
    tree = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
    for i, n, d, la, s in docs:
        if n:
            tree[d][la][s].append((i, n))
    cap = lambda ds: epochs * sum(n for _, n in ds)
    total = sum(n for _, n, *_ in docs)
    out = []
    a1 = fill(total * percent // 100, {d: (sum(cap(x) for la in t.values() for x in la.values()), w("domain", d)) for d, t in tree.items()})
    for d, t in tree.items():
        a2 = fill(a1[d], {la: (sum(cap(x) for x in s.values()), w("lang", la)) for la, s in t.items()})
        for la, s in t.items():
            a3 = fill(a2[la], {x: (cap(ds), w("source", x)) for x, ds in s.items()})
            for x, ds in s.items():
                supply = sum(n for _, n in ds)
                full, rest = divmod(a3[x], supply)
                for e in range(full):
                    out += [(i, e, n) for i, n in ds]
                for i, n in sorted(ds, key=lambda r: hashlib.md5(f"{seed}|{full}|{r[0]}".encode()).hexdigest()):
                    if rest <= 0:
                        break
                    out.append((i, full, min(n, rest)))
                    rest -= n
    return sorted(out)


@pytest.mark.parametrize(("percent", "epochs"), [(60, 2), (150, 2), (10, 1), (300, 2), (0, 1)])
def test_mix_equals_brute_force(spark, percent, epochs):
    rng = random.Random(percent)
    docs = []
    for i in range(300):
        source = "src0" if rng.random() < 0.4 else f"src{rng.randrange(9)}"
        docs.append((i, rng.randrange(0, 60), rng.choice(["en", "en", "de", None]), rng.choice([source, source, None])))
    df = table(spark, [(i, words(n), la, s) for i, n, la, s in docs]).withColumn("domain", mixing.domain_of(F.col("source")))
    got = mixing.mix(df, mixing.LEVELS, mixing.WEIGHTS, F.expr(f"(supply * {percent}) div 100"), epochs, 17)
    assert got.columns == [c for c in df.columns if c != "epoch"] + ["epoch", "n_tokens", "tokens_taken"]
    names = {None: "other"} | {f"src{k}": ["web", "books", "forum"][k % 3] for k in range(9)}
    want = brute_mix([(i, n, names[s], la, s) for i, n, la, s in docs], mixing.WEIGHTS, percent, epochs, 17)
    have = sorted((r["doc_id"], r["epoch"], r["tokens_taken"]) for r in got.collect())
    assert have == want
    supply = sum(n for _, n, *_ in docs)
    assert sum(t for *_, t in have) <= min(supply * percent // 100, epochs * supply)


def test_shortage_goes_to_siblings_first(spark):
    docs = [(1, words(10), "en", "src0"), (2, words(500), "en", "src3"), (3, words(500), "de", "src6"), (4, words(500), "en", "src1")]
    df = table(spark, docs).withColumn("domain", mixing.domain_of(F.col("source")))
    got = mixing.mix(df, mixing.LEVELS, {"domain": {"web": 1, "books": 1}, "lang": {"en": 1, "de": 1}}, F.lit(800), 1, 1)
    take = {r["doc_id"]: r["tokens_taken"] for r in got.collect()}
    # web 400, of it en 200: src0 gives 10, its sibling src3 the other 190
    assert take == {1: 10, 2: 190, 3: 200, 4: 400}


def test_mix_awkward(spark, awkward, empty):
    levels = ["lang", "source"]
    got = mixing.mix(awkward, levels, {}, F.expr("supply"), 1)
    assert Counter(r["doc_id"] for r in got.collect()) == Counter([None, 4, 5, 5, 6, 7, 8])
    assert mixing.mix(empty, levels, {}, F.expr("supply"), 1).count() == 0
    none = mixing.mix(awkward, levels, {"lang": {"en": 0}}, F.expr("supply"), 1)
    assert none.where("lang = 'en'").count() == 0


@pytest.mark.parametrize("name", [n for n in ORACLE if n in ("op4_mixing", "op3_exact_topk", "op5_ngram_jaccard_join", "op6_embedding_near_dedup")])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    rel = con.sql(ORACLE[name])
    got, cols = rel.fetchall(), rel.columns
    assert sorted(cols) == sorted(df.columns)
    assert rows(df, *cols) == sorted(got, key=str)


def check_bins(got, tokens, source, cluster, capacity):
    """No overlap, no overflow, no conflict, every token placed once."""
    bins, placed = defaultdict(list), defaultdict(int)
    for r in got:
        bins[r["bin"]].append(r)
        placed[r["doc_id"]] += r["tokens"]
    assert {i: n for i, n in placed.items()} == {i: n for i, n in tokens.items() if n}
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r["start"]):
            assert r["start"] == at and r["tokens"] > 0
            at += r["tokens"]
        assert at <= capacity
        for of in (source, cluster):
            keys = [of[r["doc_id"]] for r in b if of[r["doc_id"]] is not None]
            assert len(keys) == len(set(keys))
    return bins


def test_pack_keeps_its_constraints(spark):
    rng = random.Random(7)
    docs = [(i, words(rng.randrange(0, 300), rng.choice("abc")), "en", "src0" if rng.random() < 0.35 else f"src{rng.randrange(30)}") for i in range(600)]
    df = table(spark, docs)
    got = packing.pack(df, mixing.token_count(F.col("text")), F.col("source"), packing.text_cluster(F.col("text")), 128, batch=97, rows_per_task=200).collect()
    bins = check_bins(got, {i: len(t.split()) for i, t, *_ in docs}, {d[0]: d[3] for d in docs}, {d[0]: d[1] for d in docs}, 128)
    assert len(bins) < len(got)


def brute_best_fit(pieces, capacity):
    bins, out = [], [None] * len(pieces)
    for i in sorted(range(len(pieces)), key=lambda i: (-pieces[i][0], i)):
        size, s, c = pieces[i]
        fit = [b for b in bins if b[0] >= size and (s is None or s not in b[1]) and (c is None or c not in b[2])]
        if fit:
            b = min(fit, key=lambda b: b[0])
        else:
            b = [capacity, set(), set(), len(bins)]
            bins.append(b)
        b[0] -= size
        b[1].add(s)
        b[2].add(c)
        out[i] = b[3]
    return [[i for i, b in enumerate(out) if b == k] for k in range(len(bins))], [b[0] for b in bins]


def test_tightest_compatible_bin(spark):
    """The residuals equal those of a search through all bins."""
    for seed in range(30):
        rng = random.Random(seed)
        pieces = [(rng.randrange(1, 101), rng.choice([None, *"abcdefgh"]), rng.choice([None, *range(40)])) for _ in range(rng.randrange(0, 120))]
        got = packing.pack_batch(pieces, 100)
        used = Counter()
        for (b, at), (size, *_ ) in zip(got, pieces):
            used[b] += size
        _, residual = brute_best_fit(pieces, 100)
        assert len(used) == len(residual)
        assert sum(used.values()) == sum(100 - r for r in residual) and max(used.values(), default=0) <= 100


def test_pack_awkward(spark, awkward, empty):
    got = packing.pack(awkward, mixing.token_count(F.col("text")), F.col("source"), packing.text_cluster(F.col("text")), 2048).collect()
    n = Counter()
    for r in got:
        n[r["doc_id"]] += r["tokens"]
    assert n == Counter({None: 3, 4: 30_000, 5: 6, 6: 3, 7: 3, 8: 6})
    assert packing.pack(empty, F.lit(1), F.col("source"), F.col("text"), 2048).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs = docs.persist()
        assert 0 < docs.count() <= before, name
    assert docs.select("doc_id").distinct().count() == docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_pipeline_stages_awkward(spark, awkward, empty):
    base = ["doc_id", "text", "lang", "source", "n_chars"]
    for df in (awkward, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            assert name == "packing" or out.columns == df.columns
            out.count()
        assert set(base) <= set(df.columns)


def test_entry_without_the_subpackage(tmp_path):
    """The entry module works when the folders and the pipeline are gone."""
    for n in os.listdir(ROOT):
        if n in ("__spark_entry__.py",):
            os.symlink(f"{ROOT}/{n}", tmp_path / n)
    os.makedirs(tmp_path / "lendscope")
    for n in os.listdir(f"{ROOT}/lendscope"):
        if n != "llm":
            os.symlink(f"{ROOT}/lendscope/{n}", tmp_path / "lendscope" / n)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'iv_summary' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' in q and sum(n.startswith('op') for n in q) == 13"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, check=True, env={**os.environ, "PYTHONPATH": ROOT})
