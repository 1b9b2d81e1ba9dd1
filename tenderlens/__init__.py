"""Procurement-integrity analytics as plain Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

# functions go to Python workers by value, so that workers need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
