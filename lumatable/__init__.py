"""lumatable: image-dataset and training-run analytics as Spark DataFrames.

Images are tables (one row per image, or one row per pixel), runs are tables
(one row per log line), and every job is a DataFrame plan.
"""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
