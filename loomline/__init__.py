"""Analytics on market panels and work items, as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so that workers need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
