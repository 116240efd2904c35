"""Operators for training-data pipelines.

Functions of this package that run on executors are shipped by value, so the
executors need neither this package nor a shared code folder.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
