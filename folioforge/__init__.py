"""folioforge: a Spark-native engine for document retrieval and text-corpus analytics."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of the package are pickled by value: executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
