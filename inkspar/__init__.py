"""A full-text index, a search language and corpus preparation, as Spark plans."""

import sys

from pyspark import cloudpickle

# Executors get the functions of this package by value, so that it need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
