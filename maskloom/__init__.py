"""Finding and pseudonymising sensitive text with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# UDF bodies travel to the executors by value: no package install needed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
