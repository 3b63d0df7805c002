"""hazardlake: multi-omics survival analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Task-side helpers travel with the job, so executors need no install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
