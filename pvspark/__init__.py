"""Corpus embedding and duplicate/leakage analysis on Spark DataFrames.

Sub-packages: ``functions`` (column expressions), ``sources`` (readers and
writers), ``operators`` (DataFrame -> DataFrame building blocks) and ``plans``
(end-to-end pipelines composed from them).
"""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so executors do not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
