"""Line dedup, n-gram join, embedding near-dedup, exact search: brute-force
versions, hot groups and awkward rows."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendscope.llm import line_dedup, neardup, ngram_join, topk
from lendscope.llm.components import connected_components

from .conftest import LONG, SF, rows, table

SEPARATORS = " \t\n\v\f\r"


def union_find(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i
    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 180)] + [(7, i) for i in range(300, 400)] + [(400, 401), (401, 400), (500, 500)]
    random.Random(1).shuffle(links)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = union_find({x for e in links for x in e} - {500}, [e for e in links if e[0] != e[1]])
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, n):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w, at = [], ""
    for c in text + " ":
        if c in SEPARATORS:
            if at:
                w.append(at)
            at = ""
        else:
            at += c
    if not w:
        return set()
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def brute_join(docs, n, percent):
    sets = defaultdict(list)
    for i, t in docs:
        if i is not None:
            sets[i].append(shingles(t, n))
    ids = sorted(sets)
    links = []
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            if any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                links.append((a, b))
    comp = union_find(ids, links)
    return sorted(((i, len(shingles(t, n)), comp.get(i)) for i, t in docs), key=str)


def edited(rng, words, k):
    w = list(words)
    for _ in range(k):
        at = rng.randrange(len(w))
        how = rng.random()
        if how < 0.4:
            w[at] = f"new{rng.randrange(10**6)}"
        elif how < 0.7:
            w.insert(at, f"more{rng.randrange(10**6)}")
        elif len(w) > 1:
            del w[at]
    return w


@pytest.mark.parametrize(("n", "percent"), [(5, 80), (4, 85), (2, 60)])
def test_join_equals_brute_force(spark, n, percent):
    rng = random.Random(n * percent)
    vocabulary = [f"w{i}" for i in range(3000)]
    docs, passage = [], [rng.choice(vocabulary) for _ in range(60)]
    for size in [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 40, 60, 90, 150, 300]:
        base = [rng.choice(vocabulary) for _ in range(size)]
        for k in [0, 0, 1, 1, 2, 3, 4, 6, 9, 14]:
            docs.append(edited(rng, base, min(k, size)))
    for _ in range(30):  # a shared passage alone doesn't link
        docs.append([rng.choice(vocabulary) for _ in range(rng.randrange(20, 90))] + passage)
    docs = [(i, " ".join(w)) for i, w in enumerate(rng.sample(docs, len(docs)))]
    got = ngram_join.join(table(spark, [(i, t, "en", "s") for i, t in docs]), n, percent)
    assert rows(got) == brute_join(docs, n, percent)


def test_join_of_a_chain_within_one_hot_group(spark):
    """Members that link with some other member but not with the smallest."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    docs = [(0, " ".join(words))]
    for i in range(1, 60):
        words = edited(rng, words, 2)
        docs.append((i, " ".join(words)))
    got = ngram_join.join(table(spark, [(i, t, "en", "s") for i, t in docs]), 5, 80)
    assert rows(got) == brute_join(docs, 5, 80)


def test_join_sees_blocks_of_a_large_key(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "FLUSH", 50)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(edited(rng, base, rng.randrange(0, 6)))) for i in range(120)]
    got = ngram_join.join(table(spark, [(i, t, "en", "s") for i, t in docs]), 4, 85)
    assert rows(got) == brute_join(docs, 4, 85)


def test_key_scheme_loses_no_link():
    """Random sets and edits within the limit always share a key."""
    rng = np.random.default_rng(5)
    for percent in (80, 85, 60):
        for size in [1, 2, 3, 5, 6, 7, 8, 11, 12, 13, 19, 27, 31, 50, 80, 128, 200, 330]:
            for _ in range(20):
                a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
                drop = rng.integers(0, max(1, len(a) * (100 - percent) // 100 + 1))
                b = np.delete(a, rng.choice(len(a), min(drop, len(a) - 1), replace=False))
                b = np.unique(np.concatenate([b, rng.integers(0, 2**64, rng.integers(0, drop + 1), dtype=np.uint64)]))
                both = len(np.intersect1d(a, b))
                union = len(a) + len(b) - both
                if union == both or 100 * both < percent * union:
                    continue
                k, d = ngram_join.keys_of_sets(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), percent)
                assert set(k[d == 0].tolist()) & set(k[d == 1].tolist()), (percent, len(a), len(b))
                s = ngram_join.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
                assert np.bitwise_count(s[0] ^ s[1]).sum() <= ngram_join.max_difference(len(a), len(b), percent)


def test_join_awkward(spark, awkward, empty):
    got = ngram_join.join(awkward, 4, 85)
    want = brute_join([(r["doc_id"], r["text"]) for r in awkward.collect()], 4, 85)
    assert rows(got) == want
    assert ngram_join.join(empty, 4, 85).count() == 0


def reference_chunks(lines, hashes, window, divisor, roll):
    out, lo = [], 0
    for i in range(len(lines)):
        if roll(hashes, i) % divisor == 0 or i == len(lines) - 1:
            out.append((len(out), i - lo + 1, "\n".join(lines[lo:i + 1])))
            lo = i + 1
    return out


def test_chunks_follow_the_content(spark):
    rng = random.Random(2)
    block = [f"shared line {i} {rng.random()}" for i in range(30)]
    texts = ["\n".join([f"own {k} {j}" for j in range(k)] + block + [f"tail {k}"]) for k in range(6)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [[(c["pos"], c["n"], c["body"]) for c in r["c"]] for r in df.select("doc_id", line_dedup.chunks_of(F.col("text"), 2, 3).alias("c")).orderBy("doc_id").collect()]
    for t, chunks in zip(texts, got):
        assert "\n".join(c[2] for c in chunks) == t and [c[0] for c in chunks] == list(range(len(chunks)))
        assert all(c[1] == c[2].count("\n") + 1 for c in chunks)
    inner = [{c[2] for c in chunks} for chunks in got]
    assert len(set.intersection(*inner)) >= 5  # the same chunks in spite of shifted positions


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(6)
    pool = [f"line {i} of the pool" for i in range(12)]
    docs = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.8 else f"unique {i} {j}" for j in range(rng.randrange(0, 25))), "en", "s") for i in range(60)]
    docs += [(100, docs[3][1], "en", "s"), (101, docs[3][1], "en", "s")]
    df = table(spark, docs)
    chunks = {r["doc_id"]: [(c["pos"], c["n"], c["body"]) for c in r["c"]] for r in
              df.select("doc_id", line_dedup.chunks_of(F.col("text"), 2, 3).alias("c")).collect()}
    first, count = {}, defaultdict(int)
    for i in sorted(chunks):
        for pos, n, body in chunks[i]:
            if n >= 2:
                count[body] += 1
                first.setdefault(body, (i, pos))
    want = {}
    for i, c in chunks.items():
        left = [b for pos, n, b in c if n < 2 or count[b] < 2 or first[b] == (i, pos)]
        want[i] = ("\n".join(left), len(c) - len(left))
    got = line_dedup.dedup_lines(df)
    assert got.columns == [c for c in df.columns if c != "n_removed"] + ["n_removed"]
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in got.collect()} == want
    assert got.where("n_chars <> length(text)").count() == 0
    assert want[100][0] == want[101][0] and want[100][1] > 0


def test_line_dedup_awkward(spark, awkward, empty):
    got = line_dedup.dedup_lines(awkward)
    assert rows(got, "doc_id", "text") == rows(awkward, "doc_id", "text")
    assert got.agg(F.sum("n_removed")).first()[0] == 0
    assert line_dedup.dedup_lines(empty).count() == 0
    two = "\n".join(f"a long shared line {i}" for i in range(8))
    both = table(spark, [(None, two, "en", "s"), (3, two, "en", "s"), (4, None, "en", "s"), (5, LONG, "en", "s")])
    by = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(both).collect()}
    assert by[None] == two and len(by[3]) < len(two) and by[4] is None and by[5] == LONG


def brute_runs(docs):
    """Lines of every row that no earlier pair of lines holds; rows in order."""
    first, out = {}, []
    for at, t in enumerate(docs):
        lines = t.split("\n")
        gone = set()
        for i, pair in enumerate(zip(lines, lines[1:])):
            f = first.setdefault(pair, (at, i))
            if not (f[0] == at and i <= f[1] + 1):
                gone |= {i, i + 1}
        left = [x for i, x in enumerate(lines) if i not in gone]
        out.append(("\n".join(left), len(gone)))
    return out


def run_dirs(tmp_path, spark, docs):
    """The documents as a table that the query reads."""
    table(spark, docs).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_repeated_runs_go_whole(spark, tmp_path):
    """Every passage of two or more lines loses all its lines in all but its
    first document, in whatever context, through the query."""
    from lendscope.llm.queries import QUERIES

    docs, passages = [], [[f"passage {p} line {i}" for i in range(2 + p % 7)] for p in range(40)]
    for i in range(120):
        text = [f"head {i}"]
        for p in (i % 40, (i * 7 + 3) % 40):
            text += passages[p] + [f"own {i} {p}"]
        docs.append((i, "\n".join(text), "en", "s"))
    docs.append((200, docs[3][1], "en", "s"))
    got = {r["doc_id"]: (r["n_chars"], r["n_removed"]) for r in QUERIES["op8_line_dedup"](spark, run_dirs(tmp_path, spark, docs)).collect()}
    want = brute_runs([t for _, t, *_ in docs])
    assert got == {d[0]: (len(t), n) for d, (t, n) in zip(docs, want)}
    assert "passage" not in "".join(t for t, _ in want[40:]) and want[-1][0] == ""


def test_runs_equal_brute_force(spark):
    rng = random.Random(16)
    pool = [f"line {i} of the pool" for i in range(12)] + ["", "é漢"]
    docs = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"unique {i} {j}" for j in range(rng.randrange(0, 25))), "en", "s") for i in range(80)]
    docs += [(90, "z\nz\nz", "en", "s"), (91, "y\ny\ny\ny", "en", "s"), (92, docs[3][1], "en", "s")]
    df = table(spark, docs)
    got = line_dedup.dedup_runs(df.repartition(5))
    assert got.columns == [c for c in df.columns if c != "n_removed"] + ["n_removed"]
    want = brute_runs([t for _, t, *_ in docs])
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in got.collect()} == {d[0]: w for d, w in zip(docs, want)}
    assert got.where("n_chars <> length(text)").count() == 0
    assert want[80][0] == "z\nz\nz" and want[81][0] == "y\ny"


def test_runs_awkward(spark, awkward, empty):
    got = line_dedup.dedup_runs(awkward)
    assert rows(got, "doc_id", "text") == rows(awkward, "doc_id", "text")
    assert got.agg(F.sum("n_removed")).first()[0] == 0
    assert line_dedup.dedup_runs(empty).count() == 0


@pytest.mark.parametrize("dedup", [line_dedup.dedup_lines, line_dedup.dedup_runs])
def test_rows_with_null_or_shared_ids_are_documents_of_their_own(spark, dedup):
    """The clean lines of one row never go because of another with its id, and
    of equal texts one stays."""
    def own(i):
        return [f"only in text {i}, line {j}" for j in range(9)]
    passage = [f"a shared passage, line {j}" for j in range(40)]
    texts = ["\n".join(own(i)[:i] + passage + own(i)[i:]) for i in range(8)]
    docs = [(None, t, "en", "s") for t in texts[:6]] + [(None, texts[0], "en", "s"), (7, texts[6], "en", "s"), (7, texts[7], "en", "s"), (7, texts[7], "en", "s")]
    got = [r["text"].split("\n") for r in dedup(table(spark, docs)).collect()]
    left = [x for t in got for x in t if x]
    assert len(got) == len(docs)
    assert all(left.count(x) >= 1 for i in range(8) for x in own(i))
    # the ends of a passage may stay in chunks with their surroundings, the rest goes
    inner = [x for x in passage if left.count(x) == 1]
    assert len(inner) >= (40 if dedup is line_dedup.dedup_runs else 10)
    if dedup is line_dedup.dedup_runs:
        assert sorted(left) == sorted([x for i in range(8) for x in own(i)] + passage)


def vectors(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, n_links string, component string, score string")


def brute_cap(data, limit):
    good = [(i, np.array(e, dtype=np.float32).astype(float), la) for i, e, la in data
            if i is not None and la is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links, n = [], defaultdict(int)
    for x in range(len(good)):
        for y in range(x + 1, len(good)):
            (i, a, p), (j, b, q) = good[x], good[y]
            if p == q and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= limit:
                links.append((i, j))
                n[x] += 1
                n[y] += 1
    comp = union_find({i for i, *_ in data if i is not None}, links)
    at = iter(range(len(good)))
    out = []
    for i, e, la in data:
        usable = i is not None and la is not None and e and all(v is not None and np.isfinite(v) for v in e) and any(e)
        out.append((i, n[next(at)] if usable else 0, comp.get(i)))
    return sorted(out, key=str)


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    data, at = [], 0
    for _ in range(25):
        base = rng.normal(size=32)
        for noise in (0, 0, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5):
            v = base / np.linalg.norm(base) + noise * rng.normal(size=32) / np.sqrt(32)
            data.append((at * 7 % 1000, [float(x) for x in v.astype(np.float32)], int(rng.integers(0, 2))))
            at += 1
    data += [(2001, None, 1), (2002, [], 1), (2003, [0.0] * 32, 1), (2004, [float("nan")] + [1.0] * 31, 1), (2005, [None] + [1.0] * 31, 1),
             (2006, data[0][1], None), (None, data[0][1], data[0][2]), (2007, data[0][1][:16], data[0][2]), (2008, [float("inf")] * 32, 1),
             (2009, [3 * x for x in data[1][1]], data[1][2]), data[5]]
    got = neardup.near_duplicates(vectors(spark, [(*d, "x", "x", "x") for d in data]), 0.93)
    assert rows(got, "vec_id", "n_links", "component_id") == brute_cap(data, 0.93)
    assert all(r["kept"] == (r["vec_id"] is None or r["vec_id"] == r["component_id"]) for r in got.collect())
    assert neardup.near_duplicates(vectors(spark, []), 0.93).count() == 0


def test_near_duplicates_of_one_hot_group(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = np.random.default_rng(2)
    base = rng.normal(size=64)
    data = [(i, [float(x) for x in (base / np.linalg.norm(base) + rng.normal(size=64) * rng.uniform(0, 0.05)).astype(np.float32)], 3) for i in range(150)]
    got = neardup.near_duplicates(vectors(spark, [(*d, "x", "x", "x") for d in data]), 0.93)
    want = brute_cap(data, 0.93)
    links = sum(w[1] for w in want)
    assert sum(r["n_links"] for r in got.collect()) == pytest.approx(links, rel=0.005)


def test_cap_filters_recall_and_precision(spark):
    """Pairs just over the limit share a filter nearly always."""
    rng = np.random.default_rng(1)
    x, _ = neardup.unit(rng.normal(size=(200, 64)))
    z = rng.normal(size=x.shape)
    z, _ = neardup.unit(z - (z * x).sum(1, keepdims=True) * x)
    f = neardup.Filters(64)
    a, b = f.of(x), f.of(0.93 * x + np.sqrt(1 - 0.93**2) * z)
    shared = set(zip(*map(np.ndarray.tolist, a))) & set(zip(*map(np.ndarray.tolist, b)))
    assert len({i for i, _ in shared}) >= 0.98 * len(x)


def brute_topk(data, is_query, k):
    fine = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in e]) for i, e, _ in data
            if i is not None and e and all(x is not None and np.isfinite(x) for x in e)]
    out, seen = [], set()
    for i, q in sorted(fine, key=lambda r: (r[0], len(r[1]), r[1])):
        if not is_query(i) or i in seen:
            continue
        seen.add(i)
        best = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in fine if j != i and len(c) == len(q))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out, key=str)


@pytest.mark.parametrize("group", [16384, 16])
def test_topk_equals_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(topk, "GROUP", group)
    monkeypatch.setattr(topk, "CHUNK", 32)
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in rng.normal(size=24).astype(np.float32)], 1) for i in range(120)]
    data += [(200 + i, data[i][1], 1) for i in range(30)]  # ties
    data += [(300, None, 1), (301, [], 1), (302, [float("nan")] * 24, 1), (303, [None] * 24, 1), (None, data[0][1], 1), (304, [1.0, 2.0], 1),
             (305, [0.5, -1.0], 1), (306, [0.0] * 24, None), data[4]]
    got = topk.search(vectors(spark, [(*d, "x", "x", "x") for d in data]), F.col("vec_id") % 4 == 0, 10)
    assert rows(got, "query_id", "rank", "vec_id", "score") == brute_topk(data, lambda i: i % 4 == 0, 10)
    assert topk.search(vectors(spark, []), F.col("vec_id") % 4 == 0).count() == 0


def test_segment_bounds_hold():
    rng = np.random.default_rng(4)
    x, y = rng.integers(-2000, 2000, (50, 37)).astype(float), rng.integers(-2000, 2000, (60, 37)).astype(float)
    for s in (1, 4, 16, 36):
        lb = topk.lower_bounds(topk.segment_statistics(x, s), (x * x).sum(1), topk.segment_statistics(y, s), (y * y).sum(1))
        true = ((x[:, None] - y[None]) ** 2).sum(2)
        assert (lb <= true + 1e-6 * true).all()


def test_queries_cover_their_tables(spark):
    from lendscope.llm.queries import QUERIES

    for name, name_of in (("op5_ngram_jaccard_join", "documents"), ("op6_embedding_near_dedup", "embeddings"), ("op8_line_dedup", "documents")):
        assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{name_of}.parquet").count()


def test_runs_are_found_by_content_defined_chunks(spark, monkeypatch):
    """The chunk index gives the bulk of a long repeated passage, growth the
    lines at its ends; three blank lines inside it make no pair of their own."""
    passage = [f"shared line {i}" for i in range(60)] + ["", "", ""] + [f"shared end {i}" for i in range(4)]
    docs = [(i, "\n".join([f"head {i}", *passage, f"tail {i}"]), "en", "s") for i in range(6)]
    found, grown = [], []
    whole = line_dedup.repeated

    def spy(df, name):
        out = whole(df, name)
        (found if name == "repeated-chunks" else grown).append(out)
        return out

    monkeypatch.setattr(line_dedup, "repeated", spy)
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup_runs(table(spark, docs)).collect()}
    assert got == {d[0]: w for d, w in zip(docs, brute_runs_without_blank_pairs([t for _, t, *_ in docs]))}
    inside = sum(len(r["pairs"]) for r in found[0].where("not first").collect())
    assert inside >= 5 * 20 and grown[0].where("not first").count() >= 5


def brute_runs_without_blank_pairs(docs):
    first, out = {}, []
    for at, t in enumerate(docs):
        lines, gone = t.split("\n"), set()
        for i, pair in enumerate(zip(lines, lines[1:])):
            if "".join(pair).strip():
                f = first.setdefault(pair, (at, i))
                if not (f[0] == at and i <= f[1] + 1):
                    gone |= {i, i + 1}
        out.append(("\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)))
    return out


def test_only_texts_that_lose_lines_move(spark, monkeypatch):
    """The rows that a join by row number moves are those with removals, at
    every size; all others go on without a shuffle."""
    split, seen = line_dedup.split_rows, []

    def spy(rows, found):
        out = split(rows, found)
        seen.append((rows, found, *out))
        return out

    monkeypatch.setattr(line_dedup, "split_rows", spy)
    docs = [(i, f"alone {i}\nonly {i}\nhere {i}", "en", "s") for i in range(40)] + [(50 + i, f"own {i}\nshared first\nshared second\nend {i}", "en", "s") for i in range(3)]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")      # as at a size where nothing is small
    try:
        got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_runs(table(spark, docs).repartition(7)).collect()}
        assert got == {i: 0 for i in range(40)} | {50: 0, 51: 2, 52: 2}
        assert len(seen) == 3
        for rows, found, some, others in seen:
            numbers = {r["row"] for r in found.select("row").distinct().collect()}
            assert {r["__row"] for r in some.collect()} == numbers and some.count() + others.count() == rows.count() == 43
            assert "hashpartitioning" not in others._jdf.queryExecution().executedPlan().toString()
        assert {r["doc_id"] for r in seen[-1][2].collect()} == {51, 52}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_rows_split_by_ids_stay_whole(spark):
    """Sparse, negative, shared and null ids; a few others may be told to be among them, none is lost."""
    from lendscope.llm.common import split_by_ids

    rows = spark.range(4000).selectExpr("CASE WHEN id % 50 = 0 THEN NULL ELSE (id div 2) * 900719925474099 - 77 END AS k", "id AS n")
    ids = spark.range(300).selectExpr("(id * 3) * 900719925474099 - 77 AS x").unionByName(spark.range(1).selectExpr("CAST(NULL AS LONG) AS x"))
    some, others = split_by_ids(rows, "k", ids)
    assert some.columns == others.columns == ["k", "n"]
    assert {r["n"] for r in some.unionByName(others).collect()} == set(range(4000)) and some.count() + others.count() == 4000
    assert others.join(ids, F.col("k") == F.col("x"), "left_semi").count() == 0 and others.where("k is null").count() == 80
    assert some.join(ids, F.col("k") == F.col("x"), "left_anti").count() < 800
    none, every = split_by_ids(rows, "k", ids.limit(0))
    assert none.count() == 0 and every.count() == 4000


def test_near_duplicate_stage_leaves_no_shuffle_files_and_moves_few_texts(spark):
    """What its tables were shuffled by is gone when they are written, the texts of rows in no pair stay where they are, and
    only tables that the result reads are left."""
    import os

    import corpus_pipeline

    body = [" ".join(f"w{(i * 31 + j * 17) % 5003}x{i}" for j in range(30)) for i in range(300)]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(body)] + [(900 + i, body[i], "en", "a", len(body[i])) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {os.path.join(d, x) for top in blocks.localDirs() for d, _, names in os.walk(top.getPath())
                        for x in names if x.startswith("shuffle_") and x.endswith(".data")}
    before = shuffled()
    out = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert sum(os.path.getsize(f) for f in shuffled() - before) < 8_000          # of counts, which write no table
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(300))
    assert not any("ngram-texts" in f for f in out.inputFiles())


def test_passing_tables_go_but_the_kept_one(spark):
    from lendscope.session import discard, materialize, passing_tables

    outer = materialize(spark, spark.range(3), "outer")
    with passing_tables() as keep:
        inner = materialize(spark, outer.selectExpr("id + 1 AS id"), "inner")
        kept = keep(materialize(spark, inner.selectExpr("id * 2 AS id"), "kept"))
    assert sorted(r["id"] for r in kept.collect()) == [2, 4, 6] and outer.count() == 3
    with pytest.raises(Exception):
        inner.collect()
    discard(spark.read.parquet("/root/testdata/sf0.001/region.parquet"))     # not ours: stays
    assert spark.read.parquet("/root/testdata/sf0.001/region.parquet").count() == 5
