"""stavework: a Spark-native engine for machine-transcribed sheet music and the text around it."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions for Python workers travel with the plan, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
