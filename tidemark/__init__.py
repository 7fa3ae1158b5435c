"""Prediction-market leakage analytics as set-oriented Spark jobs."""

import sys

from pyspark import cloudpickle

# functions that run inside tasks travel with the job, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
