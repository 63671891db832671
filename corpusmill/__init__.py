"""Corpus and retrieval analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers as code, so executors need no copy of it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
