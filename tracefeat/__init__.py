"""Spark feature library.

Functions that Spark sends to Python workers are pickled by value, so that the
workers need neither this package on their path nor the driver's working folder.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
