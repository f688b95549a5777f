"""Governance and data-quality analytics as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
