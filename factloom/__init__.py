"""factloom: an evidence-based fact engine and data-processing toolkit on Spark.

The transaction log, the facts and the documents are DataFrames; every derived
state is an aggregate or a window keyed by a replay key, so it can be computed
in any order, in batch or incrementally.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
