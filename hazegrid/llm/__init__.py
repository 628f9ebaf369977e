"""Operators for preparing language-model training data at scale."""

import sys

from pyspark import cloudpickle

# functions sent to executors travel by value, so these need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
