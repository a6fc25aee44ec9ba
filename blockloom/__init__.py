"""Blockloom: a PySpark-native engine for typed document blocks, graphs, retrieval and evaluation."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to executors by value, so that workers need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
