"""Structured Streaming scorer: equals batch scoring, and a restart on the
same checkpoint picks up only new files (each applicant scored once)."""

from pyspark.sql import functions as F

import pytest

from lendscope.operators import scorecard as sc
from lendscope.operators.prep import with_defaults
from lendscope.plans.score_queries import woe_sum_model
from lendscope.sources.loan_book import loan_book
from lendscope.streaming import scoring
from lendscope.streaming.scoring import read_scored, read_sink, run_to_completion, score_applicants, score_stream
from tests.conftest import SMOKE


def test_stream_restart_is_exactly_once(spark, tmp_path):
    book = loan_book(spark, SMOKE)
    model = woe_sum_model(book)
    cols = ["loan_id", "target"] + model.features
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    first = book.where(F.col("loan_id") % 2 == 0).select(*cols)
    second = book.where(F.col("loan_id") % 2 == 1).select(*cols)
    first.write.mode("append").parquet(src)
    run_to_completion(score_stream(spark, src, first.schema, model, ["loan_id", "target"], out, ck))
    n1 = read_scored(spark, out).count()
    second.write.mode("append").parquet(src)
    run_to_completion(score_stream(spark, src, first.schema, model, ["loan_id", "target"], out, ck))
    streamed = read_scored(spark, out)
    assert n1 == first.count()
    assert streamed.count() == book.count() == streamed.select("loan_id").distinct().count()
    batch = sc.score(book, model, keep=["loan_id", "target"]).select(
        "loan_id", "target", "credit_score", "default_prob", "score_band", "decision")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


@pytest.mark.parametrize("broken", ["scores", "details"])
def test_restart_between_the_two_sinks_leaves_each_applicant_once(spark, tmp_path, monkeypatch, broken):
    book = loan_book(spark, SMOKE)
    model = woe_sum_model(book)
    asked = book.select("loan_id", *[F.when(F.col("loan_id") % 3 > 0, F.col(f)).alias(f) if f == "priority" else F.col(f) for f in model.features])
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    asked.repartition(4).write.parquet(src)
    defaults = {"priority": "1-URGENT"}
    start = lambda: score_applicants(spark, src, asked.schema, model, "loan_id", defaults, out, ck, max_files_per_trigger=2)
    whole = scoring._write_batch
    calls = []

    def failing(rows, path):
        calls.append(path)
        if len(calls) >= 3 and f"/{broken}/" in path:
            raise OSError("executor lost")
        whole(rows, path)

    monkeypatch.setattr(scoring, "_write_batch", failing)
    query = start()
    with pytest.raises(Exception, match="executor lost"):
        query.awaitTermination()
    monkeypatch.setattr(scoring, "_write_batch", whole)
    run_to_completion(start())
    filled = with_defaults(asked, defaults)
    want = sc.score(filled, model, keep=["loan_id"], new_data=True).select("loan_id", "credit_score", "default_prob", "score_band", "decision")
    scores, details = read_sink(spark, out, "scores"), read_sink(spark, out, "details")
    assert sorted(map(tuple, scores.collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, details.collect()), key=str) == sorted(map(tuple, sc.explained(filled, model, "loan_id").collect()), key=str)
    # the same points and reasons as the two batch operators
    both = sc.breakdown(filled, model, "loan_id").select("loan_id", "feature", "woe", "points")
    assert sorted(map(tuple, details.select("loan_id", "feature", "woe", "points").collect())) == sorted(map(tuple, both.collect()))
    reasons = details.where("reason is not null").select("loan_id", F.col("reason").alias("rank"), "feature", "points")
    assert sorted(map(tuple, reasons.collect())) == sorted(map(tuple, sc.reason_codes(filled, model, "loan_id").collect()))
