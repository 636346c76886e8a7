"""Music-catalogue jobs for Apache Spark: ingest, query, similarity, graph and play-event work as DataFrame code."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel by value, so that a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
