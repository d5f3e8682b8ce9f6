"""Per-Python-worker resources (models, tokenizers) for code that runs in tasks.

Task closures -- and this package, which is shipped by value -- are
unpickled afresh for every task, so a module-level cache would be rebuilt
per task. The cache lives on the ``sys`` module instead, which survives task
boundaries in a reused Python worker; entries are keyed by a content hash of
the pickled factory, computed once on the driver.
"""

from __future__ import annotations

import hashlib


def resource_key(factory) -> str:
    from pyspark import cloudpickle
    return hashlib.sha1(cloudpickle.dumps(factory)).hexdigest()


def resource(factory, key: str):
    """``factory()`` built once per Python worker process for ``key``."""
    import sys
    cache = getattr(sys, "_versio_worker_resources", None)
    if cache is None:
        cache = {}
        sys._versio_worker_resources = cache
    if key not in cache:
        cache[key] = factory()
    return cache[key]
