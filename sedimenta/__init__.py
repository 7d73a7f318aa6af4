"""Spark-native medallion analytics: cleansing, merges, dimensions, facts and views as DataFrame plans."""

import sys

from pyspark import cloudpickle

# Python workers need no copy of this package: its functions travel with the tasks that call them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
