"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is ``window`` consecutive words of a benchmark item (an item of
fewer words is one window).  Documents and items are fingerprinted: of every
``w`` consecutive k-gram hashes the smallest is kept, with k + w - 1 no longer
than a window, so every span of a window's length that a document shares with
an item holds a common fingerprint.  Fingerprints are joined; a hit is
extended: all windows of the document around it are compared, word for word,
with the benchmark's windows.  Windows of 10 words take k = 5, w = 6; items
shorter than that add the (k, w) of their own length (see ``scheme``).

Plan.  Rows are numbered and written once with their word count and the
places and values of their fingerprints (about 0.29 a word); these, without
text, meet the benchmark's distinct fingerprints.  Only texts with a hit are
read again.  Items never meet documents as pairs: benchmark windows that occur
in the same items form one class (count and two xor-ed hashes of the ids,
aggregated on the map side), a document gets the set of its classes, and the
items of a set are listed once for all documents that share the set.  The
benchmark's tables are written first, so that the optimizer knows their size
and broadcasts them under its threshold only; beyond it, it merges, and AQE
splits hot fingerprints and windows.

Defined results: a null or empty text has no words, no hits and the empty
list of items; items without words have no windows; items with a null id
count for hits, not as items; rows of the benchmark that repeat an id are one
item, rows of documents are each their own, whatever their ids; windows may
overlap and a word is hit once.  Texts are compared whole, however long (the
arrays of a single text are held in one task).  Columns of the documents that
clash with n_words, n_hit, spans and item_set are replaced.  Empty tables:
no documents give no rows, no benchmark gives no hits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

WINDOW = 10
#: A word: digits, a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Found:
    """``docs``: the documents with n_words, n_hit, spans (hit word ranges,
    first to last from 0, merged) and item_set; ``items``: item_set, items
    (ids as strings, sorted; sets without a named item are left out)."""
    docs: DataFrame
    items: DataFrame


def _bind(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    ascii_only = F.octet_length(text) == F.length(text)
    lower = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def scheme(lengths: list[int]) -> list[tuple[int, int]]:
    """(k, w) for windows of these lengths: k is about half a length (a whole
    one up to 3 words, as short k-grams would hit everywhere); lengths of equal
    k share the smallest w, so that k + w - 1 is never above a length."""
    by: dict[int, int] = {}
    for n in lengths:
        k = max(min(n, 3), (n + 1) // 2)
        by[k] = min(by.get(k, n), n - k + 1)
    return sorted(by.items())


def _range(lo: Column, hi: Column) -> Column:
    """lo to hi as an array, empty when hi is below lo."""
    return F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def _winnow(hashes: Column, k: int, w: int) -> Column:
    """array<struct<p, v>>: places and values of the kept k-grams."""
    def grams(h: Column) -> Column:
        return F.transform(_range(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(F.lit(k), *[F.get(h, i + j) for j in range(k)]))

    def places(g: Column) -> Column:
        def least(i: Column) -> Column:
            return _bind(F.slice(g, i + 1, F.lit(w)), lambda s: i + F.array_position(s, F.array_min(s)).cast("int") - 1)
        every = _range(F.lit(0), F.size(g) - w)
        return F.transform(every if w == 1 else F.array_distinct(F.transform(every, least)),
                           lambda p: F.struct(p.alias("p"), F.get(g, p).alias("v")))
    return _bind(_bind(hashes, grams), places)


def fingerprints(words: Column, kinds: list[tuple[int, int]]) -> Column:
    """array<struct<p, v>>: the winnowed k-grams of a sequence of words."""
    return _bind(F.transform(words, lambda x: F.xxhash64(x)),
                 lambda h: F.concat(F.array().cast("array<struct<p:int,v:bigint>>"), *[_winnow(h, k, w) for k, w in kinds]))


def _window_at(words: Column, start: Column, length) -> Column:
    return F.array_join(F.slice(words, start + 1, length), " ")


def benchmark_tables(benchmark: DataFrame, window: int):
    """(lengths, prints, windows, members): the lengths of windows that occur
    (at most ``window`` numbers), the distinct fingerprint values, (win, cls)
    and the ids (cls, item) of each class of windows."""
    spark = benchmark.sparkSession
    items = (benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words"))
             .where(F.size("words") > 0).withColumn("len", F.least(F.size("words"), F.lit(window))))
    items = materialize(spark, items, "winnow-items")
    lengths = sorted(r["len"] for r in items.select("len").distinct().collect())
    prints = [items.where(F.col("len").isin(ls)).select(F.explode(fingerprints(F.col("words"), [(k, w)])).alias("f")).select("f.v")
              for k, w in scheme(lengths) if (ls := [n for n in lengths if scheme([n])[0][0] == k])]
    values = prints[0] if prints else items.select(F.lit(0).cast("long").alias("v")).where("false")
    for p in prints[1:]:
        values = values.unionByName(p)
    values = materialize(spark, values.distinct(), "winnow-prints")
    wins = (items.select("item", F.explode(F.transform(_range(F.lit(0), F.size("words") - F.col("len")),
                                                       lambda i: _window_at(F.col("words"), i, F.col("len")))).alias("win")).distinct())
    wins = materialize(spark, wins, "winnow-item-windows")
    named = F.col("item").isNotNull()
    classes = (wins.groupBy("win").agg(F.count("item").alias("n"), F.bit_xor(F.when(named, F.xxhash64("item"))).alias("x"),
                                       F.bit_xor(F.when(named, F.xxhash64("item", F.lit(1)))).alias("y"))
               .select("win", F.concat_ws("/", "n", F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0))).alias("cls")))
    classes = materialize(spark, classes, "winnow-windows")
    members = (wins.where(named).join(classes.groupBy("cls").agg(F.min("win").alias("win")), "win").select("cls", "item"))
    return lengths, values, classes, members


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, summaries: dict[str, Column] | None = None) -> Found:
    """Find the benchmark's windows in whole documents; see ``Found``.
    ``summaries``: more columns of ``docs``, expressions over ``items`` that
    are computed once for each set (null for documents without hits)."""
    spark, summaries = docs.sparkSession, summaries or {}
    lengths, prints, windows, members = benchmark_tables(benchmark, window)
    made = {"n_words", "n_hit", "spans", "item_set", *summaries}
    keep = [c for c in docs.columns if c.lower() not in made]
    rows = (docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("__text"),
                        words_of(F.col("text").cast("string")).alias("__words"))
            .select(*[F.col(f"`{c}`") for c in keep], "__text", F.size("__words").cast("long").alias("n_words"),
                    fingerprints(F.col("__words"), scheme(lengths)).alias("__prints"))
            .withColumn("__row", F.monotonically_increasing_id()))
    rows = materialize(spark, rows, "winnow-rows")

    met = (rows.select("__row", F.explode("__prints").alias("f")).select("__row", "f.p", "f.v")
           .join(prints, "v", "left_semi").groupBy("__row").agg(F.collect_set("p").alias("at")))
    met = materialize(spark, met.withColumnRenamed("__row", "row"), "winnow-hits")
    texts = (rows.select("__row", "__text").join(met, F.col("__row") == F.col("row"))
             .select("row", "at", words_of(F.col("__text")).alias("words")))
    # every window that holds a hit, of every length that the benchmark has
    starts = [F.transform(F.array_distinct(F.flatten(F.transform("at", lambda p: _range(
        F.greatest(p - (n - 1), F.lit(0)), F.least(p, F.size("words") - n))))), lambda s: F.struct(s.alias("s"), F.lit(n).alias("n")))
        for n in lengths]
    none = F.array().cast("array<struct<s:int,n:int>>")
    around = (texts.select("row", "words", F.explode(F.concat(none, *starts)).alias("x"))
              .select("row", "x.s", "x.n", _window_at(F.col("words"), F.col("x.s"), F.col("x.n")).alias("win")))
    hits = around.join(windows, "win").select("row", "s", "n", "cls")
    found = (hits.groupBy("row").agg(_spans(F.collect_list(F.struct("s", "n"))).alias("spans"),
                                     F.sort_array(F.collect_set("cls")).alias("classes"))
             .select("row", "spans", "classes", F.sha2(F.array_join("classes", ","), 256).alias("item_set")))
    found = materialize(spark, found, "winnow-found")

    items = (found.groupBy("item_set").agg(F.min("classes").alias("classes"))
             .select("item_set", F.explode("classes").alias("cls")).join(members, "cls")
             .groupBy("item_set").agg(F.sort_array(F.collect_set("item")).alias("items")))
    items = materialize(spark, items, "winnow-sets")
    of_set = items.select(F.col("item_set").alias("set"), *[c.alias(name) for name, c in summaries.items()])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + (x["last"] - x["first"] + 1))
    per_row = found.select(F.col("row").alias("__id"), n_hit.alias("n_hit"), "spans", "item_set").join(of_set, F.col("item_set") == F.col("set"), "left").drop("set")
    out = (rows.select(*[F.col(f"`{c}`") for c in keep], "n_words", "__row").join(per_row, F.col("__row") == F.col("__id"), "left")
           .select(*[F.col(f"`{c}`") for c in keep], "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                   F.coalesce("spans", F.array().cast("array<struct<first:int,last:int>>")).alias("spans"), "item_set", *summaries))
    return Found(out, items)


def _spans(windows: Column) -> Column:
    """Hit words as ranges, of windows (s, n) in any order."""
    words = F.sort_array(F.array_distinct(F.flatten(F.transform(windows, lambda x: F.sequence(x["s"], x["s"] + x["n"] - 1)))))

    def ranges(p: Column) -> Column:
        first = F.filter(p, lambda x, i: (i == 0) | (x - F.get(p, i - 1) > 1))
        last = F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) - x > 1))
        return F.zip_with(first, last, lambda x, y: F.struct(x.alias("first"), y.alias("last")))
    return _bind(words, ranges)


#: The registered query in SQL.
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, COALESCE(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}'), []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
bn AS (SELECT item, w, least(len(w), {WINDOW}) AS n FROM b WHERE len(w) > 0),
bs AS (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM bn),
bw AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM bs),
ds AS (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bw)),
m AS (SELECT row, s, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM ds WHERE win IN (SELECT win FROM bw)),
p AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(s, s + n)) AS p FROM m) GROUP BY row),
i AS (SELECT row, item FROM (SELECT DISTINCT row, win FROM m) JOIN bw USING (win) WHERE item IS NOT NULL GROUP BY ALL),
g AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM i GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(n_hit, 0) AS BIGINT) AS n_hit, CAST(COALESCE(n_items, 0) AS BIGINT) AS n_items,
  sha256(COALESCE(items, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (row) LEFT JOIN g USING (row)"""
