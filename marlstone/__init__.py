"""Analytics, evidence retrieval and corpus preparation as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
