"""barloom: market analytics as Spark jobs (bars, indicators, screening, factors, backtests, ledgers, streams)."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# executors get the package's functions inside the task, so nothing has to be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
