"""Operators for preparing language-model training data.

Functions of this subpackage that run inside tasks are sent by value, so executors need
the libraries but not the package itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
