"""Posting-feed analytics on Spark: normalise, merge, filter, rank and publish postings."""
import sys

from pyspark import cloudpickle

# Python workers get the few Arrow functions by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
