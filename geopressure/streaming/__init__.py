"""Incremental refresh. What runs in Python workers is shipped by value, so they need no copy of this package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
