"""Print the physical operator tree (explain "formatted", tree part only) of
key queries.  Usage: python scripts/show_plans.py [sf_dir] [name ...]"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from lendscope.operators import ordered, woe  # noqa: E402
from lendscope.plans import load_all  # noqa: E402
from lendscope.plans.registry import QUERIES  # noqa: E402
from lendscope.session import build_session  # noqa: E402

DEFAULT = ["iv_summary", "score_book", "roc_curve", "mann_whitney", "mc_risk_metrics", "mc_md5_metrics"]


def tree(df) -> str:
    text = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return text.split("\n\n")[0]


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    names = sys.argv[2:] or DEFAULT
    spark = build_session()
    load_all()
    for n in names:
        print(f"### {n}\n```\n{tree(QUERIES[n](spark, sf_dir))}\n```\n")
    # the large-data prefix-sum path, forced on
    ordered.LOCAL_LIMIT = 0
    print(f"### roc_curve (large-data path forced)\n```\n{tree(QUERIES['roc_curve'](spark, sf_dir))}\n```\n")
    spark.stop()


if __name__ == "__main__":
    main()
