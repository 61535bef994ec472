"""Corpus analytics on Spark: DataFrame operators for building and analysing labelled document corpora."""

import sys

from pyspark import cloudpickle

# Python workers get our functions by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
