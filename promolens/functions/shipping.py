"""Python functions for executors that have no copy of this package."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship_by_value(name: str) -> None:
    """Pickle a module's functions by value; call it with __name__."""
    cloudpickle.register_pickle_by_value(sys.modules[name])
