"""Time-coded text and media-catalogue analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Step functions travel to the executors with the job, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
