"""Ordered-event analytics on Spark: gap-aware windows, as-of joins, daily statistics and execution replay."""

import sys

from pyspark import cloudpickle

# Functions go to the workers by value, so that executors need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
