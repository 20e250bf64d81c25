"""carelake: patient-registry cleaning, loading and clinic analytics on Spark.

Every operator takes and returns Spark DataFrames; the heavy lifting is done by
Catalyst/AQE over built-in expressions. See README.md for the operator map.
"""

import sys as _sys

__version__ = "0.1.0"

# The few Python functions that run inside tasks (Arrow batches) are shipped by
# value, so executors do not need this package installed.
try:
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass
