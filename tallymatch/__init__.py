"""Key reconciliation with an audit trail, as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Tasks carry the functions they call, so the package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
