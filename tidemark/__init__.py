"""Tidemark: hazard impact assessment and corpus preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions with the task, so executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
