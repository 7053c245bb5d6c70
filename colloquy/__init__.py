"""Transcript analytics on Spark: DataFrames in, DataFrames out."""

import sys

from pyspark import cloudpickle

# The helpers that run inside tasks travel with the plan: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
