"""Operators for training-data pipelines. Nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# functions of this folder travel to the executors by value: they need no copy of the package there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
