"""Prompt-preparation analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python code of the operators travels with the tasks, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
