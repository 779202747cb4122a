"""Operators for preparing training data: deduplication, filtering, scoring, mixing and formatting.

Every operator takes and returns DataFrames.  Functions that run inside Python
workers travel by value, so executors need numpy, pyarrow and xxhash but not
this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
