"""Imbalance analytics and synthetic-row evaluation for labelled tables on Spark."""

import sys

from pyspark import cloudpickle

# The helpers that run inside tasks travel with them, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
