"""Operators of a training-data pipeline: one module each, nothing outside this folder imports them.

Functions that run on executors are pickled by value, so that workers do not need this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
