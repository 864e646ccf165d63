"""Analytics over ordered observations, relations between them, and their scores, on Spark."""

import sys

from pyspark import cloudpickle

# Executors get this package's functions with the tasks, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
