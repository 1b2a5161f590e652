"""gapwright: missing-data analytics over depth-ordered, multi-channel measurements on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# task functions travel inside the job, so executors need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
