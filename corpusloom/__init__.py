"""Text-corpus preparation and analysis on Spark: DataFrame in, DataFrame out."""

import sys

from pyspark import cloudpickle

# Functions travel to executors whole, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
