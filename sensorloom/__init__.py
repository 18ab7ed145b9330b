"""Sensor time-series analytics expressed as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

# Functions handed to applyInPandas / mapInPandas travel by value, so executors
# need no copy of this package on their Python path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
