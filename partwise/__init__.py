"""Partition-wise learning on Spark: cluster rows, repair, build features, fit one model per cluster."""

import sys

from pyspark import cloudpickle

# Arrow kernels travel to the executors inside the task, so a session that was
# started without --py-files can still run them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
