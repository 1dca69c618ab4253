"""Operators for preparing language-model training data.

Nothing outside this package imports it. Its functions are sent to Python
workers by value, so that executors need no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
