"""Spark jobs for building, splitting, scoring and auditing grouped observations."""

import sys

from pyspark import cloudpickle

# Arrow functions defined in this package travel to executors by value, so a
# cluster needs nothing installed beyond PySpark, numpy and pandas.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
