"""versio: a Spark-native data engine for document-level machine translation.

Functions take and return DataFrames. Python code that runs inside tasks
(segment statistics, model and tokenizer callables) is shipped by value, so
executors do not need this package installed.
"""

import sys

try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

__version__ = "0.1.0"
