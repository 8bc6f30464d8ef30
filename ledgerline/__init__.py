"""ledgerline: a PySpark-native engine for log-replay analytics.

Python functions that Spark ships to executors are pickled by value, so
executors need no copy of this package on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
