"""Log and run analytics as Spark jobs: functions from DataFrames to DataFrames."""

import sys

from pyspark import cloudpickle

# step functions travel with the job, so executors need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
