"""DNA read analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Pandas functions and data sources travel to the executors by value, so the
# package needs to be importable on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
