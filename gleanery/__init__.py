"""Content indexing on Spark: list, read, route, extract, store and maintain."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few functions that run inside tasks travel with the job, so executors do not need
# this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
