"""A/B and H12: scans, sinks, target coding, decoding, streaming scoring."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import prep
from ..session import ensure_checkpoint_dir
from ..sources import german_credit as gc
from ..sources.io import load_loans, write_table
from ..sources.loan_book import loan_book
from ..streaming.scoring import read_scored, read_sink, run_to_completion, score_applicants, score_stream
from .registry import query
from .score_queries import BOOK_MODEL_SQL, CAT, FACTOR, NUM, TRAIN_MODEL_SQL, _score_sql, _split_model, woe_sum_model
from .sql_parts import with_loan_book


def scratch_dir(spark, name: str) -> str:
    """A fresh folder under the session's (shared) checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/lendscope-scratch/{name}-{uuid.uuid4().hex[:12]}"


@query("loan_csv_scan", with_loan_book("""
SELECT loan_id, credit_amount, CAST(1 - raw_target AS INTEGER) AS target, priority, segment FROM loan_book"""))
def loan_csv_scan_q(spark, sf_dir):
    """A1/A2: write the book as a raw CSV (German names, raw {0,1} target with
    1 = good), then scan it with an explicit schema, rename and encode."""
    raw = loan_book(spark, sf_dir).select("loan_id", F.col("credit_amount").alias("hoehe"),
                                          F.col("raw_target").alias("kredit"), "priority", "segment")
    path = scratch_dir(spark, "loans-csv")
    write_table(raw, path, fmt="csv")
    schema = "loan_id bigint, hoehe double, kredit int, priority string, segment string"
    return load_loans(spark, path, schema=schema, mapping=gc.COLUMN_MAPPING)


@query("target_encode", with_loan_book("""
SELECT loan_id, raw_target, CAST(CASE WHEN raw_target = 1 THEN 0 WHEN raw_target = 0 THEN 1 END AS INTEGER) AS target
FROM loan_book"""))
def target_encode_q(spark, sf_dir):
    """B2 on the raw {0,1} coding (1 = good)."""
    b = loan_book(spark, sf_dir).select("loan_id", "raw_target", F.col("raw_target").alias("target"))
    return prep.encode_target(b, "target")


@query("label_decode", with_loan_book("""
SELECT loan_id, target, CASE target WHEN 0 THEN 'Good' WHEN 1 THEN 'Default' END AS target_label FROM loan_book"""))
def label_decode_q(spark, sf_dir):
    """Code -> label through a literal map."""
    return prep.decode(loan_book(spark, sf_dir).select("loan_id", "target"), "target", gc.TARGET_LABELS,
                       "target_label")


@query("score_stream", with_loan_book(BOOK_MODEL_SQL + _score_sql("loan_book", False) + """
SELECT loan_id, target, credit_score, default_prob, score_band, decision FROM scored2"""))
def score_stream_q(spark, sf_dir):
    """Applicants land as parquet files; a Structured Streaming query
    scores them with the batch scorer's expressions (availableNow trigger);
    the result equals ``score_book``."""
    book = loan_book(spark, sf_dir, materialize=True)
    model = woe_sum_model(book)
    cols = ["loan_id", "target"] + model.features
    src, out, ck = scratch_dir(spark, "applicants"), scratch_dir(spark, "scored"), scratch_dir(spark, "stream-ckpt")
    applicants = book.select(*cols)
    applicants.write.mode("overwrite").parquet(src)
    q = score_stream(spark, src, applicants.schema, model, ["loan_id", "target"], out, ck)
    run_to_completion(q)
    return read_scored(spark, out)


#: What the applicant form hides for some, and the values that stand in.
FORM_DEFAULTS = {"priority": "4-NOT SPECIFIED", "n_lines": 1}


@query("applicant_stream", with_loan_book(TRAIN_MODEL_SQL + """
, form_book AS (SELECT * REPLACE (CASE WHEN loan_id % 4 = 0 THEN '4-NOT SPECIFIED' ELSE priority END AS priority,
                                  CASE WHEN loan_id % 5 = 0 THEN 1 ELSE n_lines END AS n_lines) FROM new_book)""" + _score_sql("form_book", True) + f"""
, pts AS (SELECT el.loan_id, el.feature, ROUNDX(el.woe, 4) AS woe, ROUNDX(-(1.0 * el.woe + (SELECT b0 / k FROM icp)) * {FACTOR!r}, 1) AS points FROM el)
, ord AS (SELECT *, row_number() OVER (PARTITION BY loan_id ORDER BY points,
                 CASE feature {" ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(NUM + CAT))} END) AS rank FROM pts)
SELECT s.loan_id, s.credit_score, s.default_prob, s.score_band, s.decision, o.feature, o.woe, o.points,
       CAST(CASE WHEN rank <= 3 THEN rank END AS INTEGER) AS reason FROM scored2 s JOIN ord o ON o.loan_id = s.loan_id"""))
def applicant_stream_q(spark, sf_dir):
    """Applicants arrive as files in which the form hides the
    priority of every fourth and the lines of every fifth; the stream fills
    the defaults and writes scores and explained points, read back together."""
    _, model, new = _split_model(spark, sf_dir)
    asked = new.select("loan_id", *[F.when(F.col("loan_id") % {"priority": 4, "n_lines": 5}[f] > 0, F.col(f)).alias(f) if f in FORM_DEFAULTS else F.col(f)
                                    for f in NUM + CAT])
    src, out, ck = scratch_dir(spark, "applicants"), scratch_dir(spark, "desk"), scratch_dir(spark, "desk-ckpt")
    asked.write.mode("overwrite").parquet(src)
    run_to_completion(score_applicants(spark, src, asked.schema, model, "loan_id", FORM_DEFAULTS, out, ck, max_files_per_trigger=4))
    details = read_sink(spark, out, "details").select("loan_id", "feature", "woe", "points", "reason")
    return read_sink(spark, out, "scores").join(details, "loan_id")
