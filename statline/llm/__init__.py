"""Operators for building training data, on Spark. Nothing else in the library imports this."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with the job: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
