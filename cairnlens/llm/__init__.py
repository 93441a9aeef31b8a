"""Operators for large text corpora: filtering, deduplication, mixing, packing, search.

Functions that run in Python workers are shipped by value, so that executors need
no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
