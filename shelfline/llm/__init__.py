"""Operators of a training-data pipeline; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Task code of this package travels with the job, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
