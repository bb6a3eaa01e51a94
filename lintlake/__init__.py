"""Scanning of source files and texts for weaknesses, secrets and poor quality, on Spark."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the job, so that the
# package need not be installed on the workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
