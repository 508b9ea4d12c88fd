"""Wardline: screening, curating and grading prompt text with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions handed to Python workers travel whole, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
