"""nuntia: find relevant notices in large collections of semi-structured public documents, Spark-first."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel by value, so a cluster needs no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
