"""Spark-native analytics over versioned symbol graphs.

Its Python functions are shipped by value, so executors need not have the repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
