"""Search, bounded memory and provenance over conversation archives, on Spark."""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel with them, so that executors
# do not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
