"""Batch and streaming jobs over a catalog of photographs and video frames.

Functions that run in tasks are sent to the executors by value, so the package need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
