"""Operators and queries for preparing training text. Nothing else in the package imports this folder."""

import sys

from pyspark import cloudpickle

# Ship these modules inside the task, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
