"""millrace: tables in, cleaned, profiled, queryable and scorable tables out, on Spark."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# The few Python helpers that run inside tasks travel with the job, so executors need no install.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
