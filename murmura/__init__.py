"""Murmura: chat-moderation and text analytics on Spark DataFrames.

Functions that run in Python workers travel inside the plan by value, so
executors need no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
