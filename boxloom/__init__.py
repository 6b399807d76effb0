"""Boxloom: preparing, checking and scoring object-detection data on Spark."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel by value, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
