"""Listing analytics on Spark: cleaning, change capture, price normalisation,
matching, search, reporting and price models as DataFrame operators."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
