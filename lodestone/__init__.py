"""A Spark-native engine for permit data, extraction measurement and training-data preparation.

Functions that run on executors are shipped by value, so a cluster needs no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
