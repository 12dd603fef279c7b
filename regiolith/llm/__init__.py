"""Operators for building training text at scale; nothing else in the library imports them.

Functions of this subpackage travel to the executors with the job, so executors need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
