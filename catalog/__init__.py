"""The registered queries."""

import sys

from pyspark import cloudpickle

from catalog import feeds, scalars, states, tracks  # noqa: F401
from catalog.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

cloudpickle.register_pickle_by_value(sys.modules[__name__])
