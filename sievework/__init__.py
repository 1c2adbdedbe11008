"""Corpus audit on Spark: rules, gaps, duplicates and reports over tables of text."""

import sys

from pyspark import cloudpickle

# Send the package's own functions to the executors with each job, so that nothing
# has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
