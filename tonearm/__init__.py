"""Listening analytics and recommendation as plain Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their code, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
