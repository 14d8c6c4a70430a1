"""Spark-native evaluation of step-by-step reasoning, and training-data operators."""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
