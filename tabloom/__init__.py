"""tabloom: tabular sample preparation and in-context prediction as Spark jobs."""

import sys

from pyspark import cloudpickle

# Python tasks carry the package's functions with them, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
