"""Data preparation, profiling, forecasting and inventory analytics on Spark DataFrames.

Operators are plain functions ``DataFrame -> DataFrame``.  Operators that must learn
something from the data first (a mean, a set of levels, a lambda) return an object with
``transform(df)``, or take the learned values as a parameter.
"""

import sys

from pyspark import cloudpickle

# The small functions that run in Python workers travel with their tasks, so the package need
# not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
