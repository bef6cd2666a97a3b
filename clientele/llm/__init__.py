"""Operators of a training-data pipeline: secrets, quality, dedup, sharding, search, mixing,
personal data and tokenization. Nothing else in the library imports this subpackage.

Functions that run in tasks are sent by value, so executors need not have the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
