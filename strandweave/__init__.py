"""strandweave: translated-read evidence as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Kernels travel to the executors by value, so a job runs where the package is only on the driver's path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
