"""Change-stream quality analytics as plain PySpark DataFrame functions."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel with the task; executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
