"""A Spark-native engine for schema-driven information extraction over large text collections."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
