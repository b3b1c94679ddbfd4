"""Spark-native analytics for conversation data: profile, check and judge an organisation's raw material."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to executors by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
