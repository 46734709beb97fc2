"""bookweave: order-event feeds, limit order books and training-data operators as Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that run in Python workers travel by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
