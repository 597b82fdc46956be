"""Longitudinal cohort analysis as Spark DataFrame, SQL and MLlib jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
