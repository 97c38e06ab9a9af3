"""Structured-record evaluation and data processing as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code with them, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
