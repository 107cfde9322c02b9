"""Operators of a large-scale training-data pipeline.

Functions that run inside Python workers are shipped by value, so the cluster's workers need Spark's
own Python set-up and the third-party libraries, not a copy of this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
