"""wardlake: hospital analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# The few Arrow-batched Python functions travel inside the job, so executors need no install.
register_pickle_by_value(sys.modules[__name__])
