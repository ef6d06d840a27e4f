"""A PySpark-native document analytics engine.

Functions that run on executors are pickled by value, so a worker needs no copy
of the package on its path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
