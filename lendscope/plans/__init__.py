"""Named query plans over the driver tables (registered in __spark_entry__)
and their DuckDB oracle SQL."""

import importlib

_MODULES = ["profile_queries", "woe_queries", "hypothesis_queries", "eval_queries", "score_queries", "risk_queries", "io_queries", "model_queries",
            "record_queries", "logit_queries", "loss_queries", "tree_queries"]


def load_all() -> None:
    for m in _MODULES:
        importlib.import_module(f"{__name__}.{m}")
