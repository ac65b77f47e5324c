"""voltaic: analytics jobs on Spark."""

import sys

from pyspark import cloudpickle

# functions shipped to Python workers are pickled by value, so workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
