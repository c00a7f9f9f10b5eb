"""Spark-native analytics over stand-off annotations of text and audio documents."""

import sys

from pyspark import cloudpickle

# Kernels travel to the executors by value, so a cluster needs no copy of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
