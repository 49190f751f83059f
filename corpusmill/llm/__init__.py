"""Operators on training text: mixing, deduplication, extraction, search, storage and language.

The functions that run in Python workers travel by value, so executors don't need this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
