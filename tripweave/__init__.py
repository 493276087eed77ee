"""Trip-demand analytics expressed as Spark DataFrame operators.

Every operator takes and returns DataFrames.  Nothing here keeps rows on the
driver: the only values fetched are one-row aggregates (bounds, counts, means)
that later turn into literals of the plan.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run in Python workers travel with their code, so the package
# need not be installed on the executors.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
