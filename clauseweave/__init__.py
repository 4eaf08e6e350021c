"""Contract and clause analysis on Spark."""

import sys

from pyspark import cloudpickle

# Tasks get the functions they run by value: workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
