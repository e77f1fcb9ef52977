"""Radar captures, and the text corpora that train models, as Spark jobs.

Functions that run inside tasks are shipped by value, so a cluster needs no
copy of this package on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
