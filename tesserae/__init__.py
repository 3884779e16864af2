"""Spark-native analytics over typed knowledge records."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: they need no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
