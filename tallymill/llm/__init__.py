"""Operators for preparing language-model training data."""

import sys

from pyspark import cloudpickle

# functions of this subpackage travel to Python workers by value: executors need the libraries, not the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
