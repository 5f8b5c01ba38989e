"""Contract validation of architecture documents on Spark, and training-data operators beside it."""

from pyspark import cloudpickle as _cloudpickle

# Functions that run on executors travel by value, so a worker needs pyspark, numpy and pyarrow
# but not this package on its path.
_cloudpickle.register_pickle_by_value(__import__(__name__))
