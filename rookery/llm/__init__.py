"""Operators for preparing language-model training data.

Each module holds one operator with its own general interface; ``queries``
registers one query per operator. Nothing else in the library imports this
subpackage.

Functions of the subpackage travel to the Python workers by value, so that the
executors need no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
