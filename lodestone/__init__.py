"""Lodestone: similarity-based component identification and training-data operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so these need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
