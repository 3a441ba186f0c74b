"""Document-catalog engine on Spark: ingest, browse, rank, facet and export."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the plan, so executors do
# not need this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
