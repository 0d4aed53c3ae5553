"""Operators of a training-data pipeline: filtering, deduplication, mixing, tokenising, search and fixity."""

import sys

from pyspark import cloudpickle

# functions of this package travel to Python workers with the query, so executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
