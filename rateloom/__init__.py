"""rateloom: a Spark-first engine for byte-budgeted rate-distortion analytics and corpus preparation."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so a cluster needs no copy of this package on its Python path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
