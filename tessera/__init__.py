"""Data-processing queries as PySpark DataFrame jobs.

Functions that run inside tasks are pickled by value, so executors need no copy of this package on their path.
Values to broadcast are pickled by reference: keep them to arrays, tuples and dicts.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
