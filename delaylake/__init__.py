"""Spark-first engine for nonlinear prediction of time series."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Kernels travel to the executors by value, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
