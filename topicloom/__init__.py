"""Text and topic analytics as functions from DataFrame to DataFrame."""

import sys

from pyspark import cloudpickle

from topicloom.session import checkpoint, get_spark

# Functions of this package travel to the workers with the job, so that nothing has to be installed
# on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["checkpoint", "get_spark"]
