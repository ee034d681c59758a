"""Statistics for complex samples (strata, clusters, weights, fpc) on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from designstats.operators.design import Design

__all__ = ["Design"]

# Functions of this package travel to the executors by value: only the driver needs it on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
