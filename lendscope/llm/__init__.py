"""Operators of a training-data pipeline (language id, model scoring, search,
mixing, joins, deduplication, classifiers, packing)."""

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
