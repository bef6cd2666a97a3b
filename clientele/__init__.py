"""clientele: behavioural client profiles from e-commerce event logs, on Spark.

Functions that run inside Python workers (the session split, the plug-in calculators) are
pickled by value, so executors need no copy of this package on their path.
"""

import sys as _sys

try:
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass
