"""Operators for large text corpora; nothing else in the library imports this package.

Functions of this package that run in Python workers are pickled by value, so the
workers need no copy of the library on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
