"""tickloom: market-data analytics as Spark DataFrame transformations."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Python functions that run inside tasks travel by value, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
