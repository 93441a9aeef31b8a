"""Artifact-security analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value: executors need no copy of the
# package, and a session may be started from any folder.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
