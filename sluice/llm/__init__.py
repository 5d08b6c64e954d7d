"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. Functions that run on the
executors are pickled by value, so executors need only the third-party
libraries and not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
