"""The registered queries of the subpackage: each applies its operator with
production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import collocations, fim, langid, line_dedup, lm_scoring, mixing, neardup, ngram_join, packing, quality, topk, toxicity, winnowing
from .common import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@query("op1_language_id")
def op1_language_id(spark, sf_dir):
    """Language of every document by zstandard dictionaries learnt from the
    documents outside the held-out third."""
    docs = read_table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 3, 1)
    dictionaries = langid.fit(docs, ~out)
    return (langid.predict(docs, dictionaries, carry=["doc_id"])
            .select("doc_id", out.alias("held_out"), "lang_pred", "score", "accepted"))


MIX_PERCENT, MIX_EPOCHS, MIX_SEED = 60, 2, 17


@query("op4_mixing", mixing.oracle_sql(MIX_PERCENT, MIX_EPOCHS, MIX_SEED))
def op4_mixing(spark, sf_dir):
    """A budget of 60 % of all tokens through the tree domain, language,
    source, at most two epochs of a source; the selected documents."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"])
    docs = docs.withColumn("domain", mixing.domain_of(F.col("source")))
    budget = F.expr(f"(supply * {MIX_PERCENT}) div 100")
    got = mixing.mix(docs, mixing.LEVELS, mixing.WEIGHTS, budget, MIX_EPOCHS, MIX_SEED)
    return got.select("doc_id", "domain", "lang", "source", "epoch", "n_tokens", "tokens_taken")


@query("op7_toxicity")
def op7_toxicity(spark, sf_dir):
    """Toxicity score of every document by a subword-bag softmax learnt from
    labels outside the held-out third."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    out = held_out(F.col("doc_id"), 3, 1)
    model = toxicity.fit(docs, labels, ~out)
    return (toxicity.score(docs, model, 0.7, carry=["doc_id"])
            .select("doc_id", out.alias("held_out"), "score", "predicted"))


@query("op8_line_dedup")
def op8_line_dedup(spark, sf_dir):
    """Every document without its globally repeated runs of two or more lines."""
    docs = read_table(spark, sf_dir, "documents")
    return line_dedup.dedup_runs(docs).select("doc_id", "n_removed", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("op9_quality")
def op9_quality(spark, sf_dir):
    """Quality score of every document by a factorisation machine learnt from
    labels outside the held-out fifth."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    out = held_out(F.col("doc_id"), 5, 0)
    model = quality.fit(docs, labels, ~out)
    return (quality.score(docs, model, 0.3, carry=["doc_id"])
            .select("doc_id", out.alias("held_out"), "score", "predicted"))


_SHINGLES_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, c) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, COALESCE(m.c, n.doc_id) AS component_id
FROM n LEFT JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON m.id = n.doc_id"""


@query("op5_ngram_jaccard_join", _SHINGLES_SQL)
def op5_ngram_jaccard_join(spark, sf_dir):
    """Components of documents whose 4-word shingle sets have a Jaccard
    similarity of 0.85 or more."""
    return ngram_join.join(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), 4, 85)


@query("op10_packing")
def op10_packing(spark, sf_dir):
    """Every document's tokens (words) packed into bins of 2,048; no bin has
    two pieces of one source or of one group of equal texts."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "source"])
    return packing.pack(docs, mixing.token_count(F.col("text")), F.col("source"), packing.text_cluster(F.col("text")), 2048)


_TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""


@query("op3_exact_topk", _TOPK_SQL)
def op3_exact_topk(spark, sf_dir):
    """The 10 highest integer inner products of every vector whose id is
    divisible by 100 with all other vectors."""
    vectors = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return topk.search(vectors, F.col("vec_id") % 100 == 0, 10)


_CAP_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(id, c) AS (SELECT DISTINCT a, a FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT x.vec_id, CAST(COALESCE(n.n, 0) AS BIGINT) AS n_links, COALESCE(m.c, x.vec_id) AS component_id,
  x.vec_id = COALESCE(m.c, x.vec_id) AS kept
FROM embeddings x LEFT JOIN m ON m.id = x.vec_id LEFT JOIN n ON n.a = x.vec_id"""


@query("op6_embedding_near_dedup", _CAP_SQL)
def op6_embedding_near_dedup(spark, sf_dir):
    """Links and components of embeddings of equal label with a cosine of
    0.93 or more."""
    return neardup.near_duplicates(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"]), 0.93)


@query("op2_lm_scoring")
def op2_lm_scoring(spark, sf_dir):
    """Cross-entropy difference of every document: documents labelled good
    and not toxic as the target, all documents as the background."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    good = lm_scoring.good_ids(read_table(spark, sf_dir, "labels"))
    # a merge join at every size: the ids grow with the labels and are never broadcast
    marked = docs.join(good.hint("merge"), docs.doc_id == good["__good"], "left")
    return lm_scoring.score_grams(marked, F.col("__good").isNotNull(), carry=["doc_id"])


@query("op12_winnowing", winnowing.ORACLE_SQL)
def op12_winnowing(spark, sf_dir):
    """Words of every document inside 10-word windows of benchmark items."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    found = winnowing.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), summaries={
        "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256)})
    return found.docs.select("doc_id", "n_words", "n_hit", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
                             F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
                             (F.col("n_hit") > 0).alias("contaminated"))


@query("op13_fim", fim.ORACLE_SQL)
def op13_fim(spark, sf_dir):
    """Fill-in-middle form of every document, and the text restored from it."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return (fim.transform(docs, carry=["doc_id"])
            .select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                    F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")))


@query("op11_collocations", collocations.ORACLE_SQL)
def op11_collocations(spark, sf_dir):
    """The 2,000 strongest phrases of 2 to 4 words of every language."""
    return collocations.collocations(read_table(spark, sf_dir, "documents", ["lang", "text"]))
