"""Operators for preparing training data at scale; nothing else in the package imports them."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the tasks, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
