"""PySpark-native analytics for crawled municipal policy documents."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the executors with the job, so a cluster
# needs no copy of it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
