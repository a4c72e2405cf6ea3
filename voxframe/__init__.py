"""voxframe: preparing and evaluating segmentation datasets as Spark tables.

Masks are sparse voxel rows ``(case_id, x, y, z)``, intensities are slice rows
with a pixel array, and every operator maps DataFrames to DataFrames.
"""

import sys

from pyspark import cloudpickle

# task functions travel by value, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
