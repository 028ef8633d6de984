"""tessera: basket co-occurrence graphs, communities and table operators on Spark."""

import sys as _sys

__version__ = "0.1.0"

try:  # ship functions of this package to Python workers by value (no install on executors)
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - pyspark missing or older cloudpickle
    pass
