"""Line dedup in DataFrame functions only: content-defined chunks of lines as
the index, compared byte by byte, and matches grown line by line.

Chunks: the lines of a text are hashed; a rolling hash over ``window``
consecutive line hashes ends a chunk after a line when it falls in one of
``divisor`` residue classes, so boundaries follow the content and shift with
it.  Chunks of at least ``min_lines`` lines and ``min_chars`` characters whose
hash occurs more than once anywhere are compared byte by byte (grouped by
their full text); of equal ones the first in (doc_id, hash of the text, row,
position) order stays, all others are repeated.

Runs (``dedup_runs``, what the query and the pipeline use): repeated chunks
are grown by the lines at their ends, as a passage shares the chunks at its
ends with its surroundings, and a short one may have no chunk of its own.  A
line next to a repeated chunk, or in no such chunk, goes if the pair that it
makes with a neighbour has occurred before, compared by the SHA-256 of its bytes.  So of each repeated run of two or more lines
the later occurrences go whole, whatever surrounds them, and a copy of every
removed line stays.  Pairs inside a repeated chunk are not looked up: the copy
that stays holds their first occurrence.  A pair of two equal lines that
overlaps its own first occurrence doesn't count as a later one.
``dedup_lines`` removes the repeated chunks alone, without growth.

Plan: the rows are written once with a row number, which is the key of all
removals; one pass writes the chunk hashes (no text), whose count is partially
aggregated, so a chunk that occurs in a third of all documents is one row per
task before the shuffle; only rows with a repeated hash are exploded again with
their text, and grouped by it.  The pairs outside repeated chunks go the same
way.  The removals, one small array per row, join back on the row number.
Which rows a join needs is told by a bitmap of row numbers that is broadcast, one
bit a row: the texts of all other rows stay where they are, at every size.

Defined results: every row is a document of its own, whatever its id (null,
shared or not); a null text stays null and an empty text empty; a text whose
lines are all removed becomes empty; rows with null id come before all others.
Empty lines are lines, but blank lines alone are no run of their own.  Other
columns pass through; ``n_chars``, if there, is set to the new text's length
where the text changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _bind(value: Column, body) -> Column:
    """body(value) with ``value`` evaluated once: a lambda's variable isn't
    computed anew for each use in nested functions."""
    return F.get(F.transform(F.array(value), body), 0)


def chunks_of(text: Column, window: int, divisor: int) -> Column:
    """array<struct<pos, n, body, line>>: the content-defined chunks of a text,
    ``line`` the place of the first line."""
    def is_end(hashes: Column, i: Column) -> Column:
        # rolling hash of the window that ends at line i, in the order of its lines
        past = [F.coalesce(F.get(hashes, i - k), F.lit(0).cast("long")) for k in range(window - 1, -1, -1)]
        return (F.pmod(F.xxhash64(*past), F.lit(divisor)) == 0) | (i == F.size(hashes) - 1)

    def ends_of(hashes: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: is_end(hashes, i))

    def cut(lines: Column) -> Column:
        ends = _bind(F.transform(lines, lambda x: F.xxhash64(x)), ends_of)
        return _bind(ends, lambda e: F.transform(e, lambda hi, j: _bind(
            F.when(j == 0, F.lit(0)).otherwise(F.get(e, j - 1) + 1),
            lambda lo: F.struct(j.alias("pos"), (hi - lo + 1).alias("n"),
                                F.array_join(F.slice(lines, lo + 1, hi - lo + 1), "\n").alias("body"), lo.alias("line")))))

    return _bind(F.split(text, "\n", -1), cut)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` written once with a row number ``__row``, the key of removals."""
    return materialize(docs.sparkSession, docs.drop("n_removed").withColumn("__row", F.monotonically_increasing_id()), "numbered-rows")


def split_rows(rows: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered ``rows`` whose number is a ``row`` of ``found``, and all others,
    without a shuffle of ``rows``."""
    number = F.col("row").cast("long")
    bits = (found.select(F.bitmap_bucket_number(number).alias("__bucket"), F.bitmap_bit_position(number).alias("__at"))
            .groupBy("__bucket").agg(F.bitmap_construct_agg("__at").alias("__bits")))
    bits = materialize(rows.sparkSession, bits, "row-bits")
    at = F.bitmap_bit_position("__row")
    byte = F.conv(F.hex(F.substr("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (at % 8).cast("int")), F.lit(0)) == 1
    told = rows.withColumn("__bucket", F.bitmap_bucket_number("__row")).join(F.broadcast(bits), "__bucket", "left").withColumn("__hit", hit)
    return tuple(told.where(side).select(*[f"`{c}`" for c in rows.columns]) for side in (F.col("__hit"), ~F.col("__hit")))


def with_places(rows: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """Numbered ``rows`` with the array ``name`` of ``found`` (row, name), null
    where there is none; only rows that have one move, by a plan that is the
    same at every size."""
    some, others = split_rows(rows, found)
    joined = some.join(found.withColumnRenamed("row", "__id").hint("merge"), F.col("__row") == F.col("__id"), "left").drop("__id")
    return joined.unionByName(others.withColumn(name, F.lit(None).cast(found.schema[name].dataType)))


def repeated(found: DataFrame, name: str) -> DataFrame:
    """The rows of ``found`` (doc_id, row, h, pos, body and others) whose body
    occurs more than once, by hash and then by its bytes: (row, pos, others,
    first, first_row, first_pos); ``first`` tells which occurrence stays."""
    key = F.struct(F.xxhash64("body").alias("h"), F.length("body").alias("len"))
    hashed = found.select(key.alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k")
    occ = found.withColumn("k", key).join(hashed, "k", "left_semi").drop("k")
    occ = materialize(found.sparkSession, occ, name)
    place = F.struct("doc_id", "h", "row", "pos")
    first = occ.groupBy("body").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    others = [c for c in found.columns if c not in ("doc_id", "row", "h", "pos", "body")]
    return occ.join(first, "body").select("row", "pos", *others, place.eqNullSafe(F.col("first")).alias("first"), F.col("first.row").alias("first_row"),
                                          F.col("first.pos").alias("first_pos"))


def repeated_chunks(rows: DataFrame, window: int = 2, divisor: int = 3, min_lines: int = 2,
                    min_chars: int = 1, blank: bool = True) -> DataFrame:
    """Every occurrence of a repeated chunk in numbered rows (as ``repeated``),
    with the places of the pairs of lines in it (none of two blank lines);
    ``blank``: chunks of blank lines alone count, too."""
    # explode_outer: no size filter is inferred that would evaluate the chunks twice
    def chunks_in(rows: DataFrame) -> DataFrame:
        chunks = (rows.where(F.col("text").contains("\n"))
                  .select("doc_id", F.col("__row").alias("row"), F.xxhash64("text").alias("h"), F.explode_outer(chunks_of(F.col("text"), window, divisor)).alias("c"))
                  .where((F.col("c.n") >= min_lines) & (F.length("c.body") >= min_chars)))
        return chunks if blank else chunks.where(F.col("c.body").rlike(r"\S"))

    hashes = materialize(rows.sparkSession, chunks_in(rows).select("row", F.xxhash64("c.body").alias("k")), "chunk-hashes")
    twice = hashes.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k")
    some, _ = split_rows(rows, hashes.join(twice.hint("merge"), "k", "left_semi"))
    chunks = chunks_in(some)
    inner = _bind(F.split("c.body", "\n", -1), lambda lines: F.filter(
        F.sequence(F.lit(0), F.size(lines) - 2), lambda i: F.concat(F.get(lines, i), F.get(lines, i + 1)).rlike(r"\S")))
    inside = F.when(F.col("c.n") > 1, F.transform(inner, lambda i: F.col("c.line") + i)).otherwise(F.array().cast("array<int>"))
    return repeated(chunks.select("doc_id", "row", "h", "c.pos", inside.alias("pairs"), "c.body"), "repeated-chunks")


def dedup_lines(docs: DataFrame, window: int = 2, divisor: int = 3, min_lines: int = 2, min_chars: int = 1) -> DataFrame:
    """``docs`` without the repeated chunks; adds ``n_removed`` (chunks)."""
    rows = numbered(docs)
    gone = (repeated_chunks(rows, window, divisor, min_lines, min_chars).where(~F.col("first"))
            .groupBy("row").agg(F.collect_set("pos").alias("__gone")))
    kept = F.filter(chunks_of(F.col("text"), window, divisor), lambda c: ~F.array_contains(F.col("__gone"), c["pos"]))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda c: c["body"]), "\n"))
    out = with_places(rows, materialize(rows.sparkSession, gone, "removals"), "__gone")
    cols = [c for c in docs.columns if c != "n_removed"]
    n_chars = [F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType).alias("n_chars")] if "n_chars" in cols else []
    return out.select(*[text.alias("text") if c == "text" else n_chars[0] if c == "n_chars" else F.col(f"`{c}`") for c in cols],
                      F.when(F.col("text").isNotNull(), F.coalesce(F.size("__gone"), F.lit(0))).otherwise(F.lit(0)).alias("n_removed"))


def line_pairs(text: Column, done: Column) -> Column:
    """array<struct<pos, len, body>>: the pairs of neighbouring lines of a
    text, as the first line's position, the length and the SHA-256 of the bytes,
    but those whose first line's position is in ``done`` and those of two blank
    lines."""
    def pairs(lines: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(lines) - 2)
        left = F.when(done.isNull(), at).otherwise(F.array_except(at, done))
        return F.filter(F.transform(left, lambda i: _bind(F.concat_ws("\n", F.get(lines, i), F.get(lines, i + 1)), lambda body: F.struct(
            i.alias("pos"), F.when(body.rlike(r"\S"), F.length(body)).otherwise(0).alias("len"), F.unhex(F.sha2(body, 256)).alias("body")))),
            lambda p: p["len"] > 0)

    return _bind(F.split(text, "\n", -1), pairs)


def later_pairs(rows: DataFrame, min_chars: int = 1) -> DataFrame:
    """(row, gone): for each ``__row`` of ``rows`` the positions of its pairs
    of lines that have occurred before: those inside repeated chunks, and by
    growth those that join them to the lines around or lie in no such chunk."""
    chunks = (repeated_chunks(rows, min_chars=min_chars, blank=False).where(~F.col("first"))
              .select("row", F.explode("pairs").alias("pos")))
    done = materialize(rows.sparkSession, chunks.groupBy("row").agg(F.collect_set("pos").alias("done")), "chunk-removals")
    open_ = (with_places(rows, done, "done").where(F.col("text").contains("\n"))
             .select("doc_id", F.col("__row").alias("row"), F.xxhash64("text").alias("h"), F.explode_outer(line_pairs(F.col("text"), F.col("done"))).alias("p"))
             .where(F.col("p.len") >= min_chars))
    grown = (repeated(open_.select("doc_id", "row", "h", "p.pos", "p.body"), "repeated-pairs")
             .where((F.col("row") != F.col("first_row")) | (F.col("pos") > F.col("first_pos") + 1)))
    both = done.select("row", F.explode("done").alias("pos")).unionByName(grown.select("row", "pos"))
    return both.groupBy("row").agg(F.collect_set("pos").alias("gone"))


def dedup_runs(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """``docs`` without the later occurrences of every repeated run of two or
    more lines; adds ``n_removed`` (lines)."""
    rows = numbered(docs)
    gone = materialize(rows.sparkSession, later_pairs(rows, min_chars).withColumnRenamed("gone", "__gone"), "removals")
    cols = [c for c in docs.columns if c != "n_removed"]

    def cut(lines: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(lines) - 1)
        hit = F.array_union(F.col("__gone"), F.transform("__gone", lambda i: i + 1))
        return _bind(F.array_except(every, hit), lambda left: F.struct(
            F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n").alias("text"),
            (F.size(lines) - F.size(left)).alias("n")))

    out = (with_places(rows, gone, "__gone")
           .withColumn("__cut", F.when(F.col("__gone").isNotNull(), _bind(F.split("text", "\n", -1), cut))))
    text = F.when(F.col("__cut").isNull(), F.col("text")).otherwise(F.col("__cut.text"))
    made = {"text": text}
    if "n_chars" in cols:
        made["n_chars"] = F.when(F.col("__cut").isNull(), F.col("n_chars")).otherwise(F.length("__cut.text")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[made[c].alias(c) if c in made else F.col(f"`{c}`") for c in cols],
                      F.coalesce(F.col("__cut.n"), F.lit(0)).alias("n_removed"))
