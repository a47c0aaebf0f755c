"""Spark-native engine for privacy-preserving record linkage experiments."""

import sys

from pyspark import cloudpickle

# Functions sent to workers carry their code along, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
