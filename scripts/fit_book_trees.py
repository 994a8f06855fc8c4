"""Fit the two small ensembles that the ``*_table_*`` queries score with and
write their node tables (lendscope/plans/book_trees.json).

Usage: python scripts/fit_book_trees.py [sf_dir]
"""

from __future__ import annotations

import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier  # noqa: E402
from pyspark.ml.feature import VectorAssembler  # noqa: E402

from lendscope.operators import trees  # noqa: E402
from lendscope.plans.tree_queries import FEATURES, MODEL_FILE, tree_features  # noqa: E402
from lendscope.session import build_session, ensure_checkpoint_dir  # noqa: E402
from lendscope.sources.loan_book import loan_book  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(tree_features(loan_book(spark, sf_dir)))
    fitted = {"forest": RandomForestClassifier(labelCol="target", numTrees=6, maxDepth=3, seed=42).fit(data),
              "boosted": GBTClassifier(labelCol="target", maxIter=6, maxDepth=3, stepSize=0.3, seed=42).fit(data)}
    out = {k: json.loads(trees.tree_table(m, FEATURES, ensure_checkpoint_dir(spark)).to_json()) for k, m in fitted.items()}
    with open(MODEL_FILE, "w") as f:
        json.dump(out, f, indent=0)
    spark.stop()


if __name__ == "__main__":
    main()
