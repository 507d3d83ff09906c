"""Operators for building training corpora, one module per operator.

Functions that run inside Python tasks are pickled by value, so executors need numpy,
pyarrow and xxhash but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
