"""Batch engine for vulnerability intelligence on Spark."""

import sys

from pyspark import cloudpickle

# Python steps travel to the executors with their code, which need not have the
# package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
