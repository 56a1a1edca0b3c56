"""quern: Spark-native operators for curating text, vectors and entity data.

Every operator takes DataFrames (or Columns) and returns DataFrames (or Columns); the plan is
declared and left to Catalyst.  Sub-packages: ``functions`` (Column kernels), ``operators``
(DataFrame operators), ``sources`` (readers and sinks), ``streaming``, ``plans`` (registered
queries with their SQL twins) and the optional ``llm`` (operators for training data).
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Executors need no copy of this package: functions sent to them carry their code along.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
