"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric": "total_query_seconds", "value": N,
"unit": "sec", "queries": {name: sec}, "sf": ..., ...}.  Each query is
forced to completion with the ``noop`` sink (full computation, nothing
collected).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "iv_summary", "woe_table", "woe_encoded", "describe", "iqr_outliers", "box_stats", "corr_matrix",
    "mann_whitney", "chi_square", "normality_screen",
    "roc_curve", "model_metrics", "hosmer_lemeshow", "ks_curve", "cost_threshold",
    "scorecard", "score_book", "band_performance", "reason_codes", "score_stream",
    "stratified_split", "logit_coefficients", "logit_test_metrics",
    "portfolio_summary", "el_by_bucket", "mc_md5_metrics", "mc_risk_metrics",
]


def _sf_value(sf_dir: str):
    found = re.findall(r"sf([0-9.]+)", sf_dir)
    try:
        return float(found[0].rstrip("."))
    except (IndexError, ValueError):
        return sf_dir


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    from lendscope.plans import load_all
    from lendscope.plans.registry import QUERIES
    from lendscope.session import build_session
    from lendscope.sources.loan_book import loan_book

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    load_all()
    # warm-up: JVM, Python workers, parquet footers
    QUERIES["basic_info"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    QUERIES["mc_md5_losses"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    # the book that most queries share is written once; its time stands on its own line
    t0 = time.time()
    loan_book(spark, sf_dir, materialize=True)
    times["loan_book_write"] = round(time.time() - t0, 3)
    for name in only or HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    n_loans = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": _sf_value(sf_dir), "cpus": int(cpus),
           "n_loans": n_loans}
    if "mc_risk_metrics" in times:
        out["mc_cells_per_sec"] = round(10_000 * n_loans / times["mc_risk_metrics"])
    # the reference's own scale: 10,000 simulations of a ~1,000-loan book
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if not only and os.path.isdir(small):
        t0 = time.time()
        QUERIES["mc_risk_metrics"](spark, small).write.format("noop").mode("overwrite").save()
        out["mc_reference_scale_sec"] = round(time.time() - t0, 3)
        out["mc_reference_scale_loans"] = spark.read.parquet(f"{small}/orders.parquet").count()
    from lendscope.sources.loan_book import release_books

    release_books(spark)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
