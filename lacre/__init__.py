"""Lacre: document-integrity analytics expressed as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the plan; the package needs no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
