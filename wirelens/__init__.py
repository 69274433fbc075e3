"""wirelens: network-behaviour analytics as Spark DataFrame, ML and streaming jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that run inside Python workers travel with the job, so executors need no copy of the
# package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
