"""Inkwell: retrieval, memory and evaluation analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from inkwell.config import DEFAULTS, Settings

# Functions sent to Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["DEFAULTS", "Settings"]
