"""Operators for preparing training data.

Functions that run in Python workers are shipped by value, so that workers need the libraries they use (numpy, pyarrow,
xxhash, a tokenizer library) but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
