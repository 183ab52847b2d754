"""solterra: a terrain analytics engine on Spark DataFrames.

Rasters, meshes, polygons, solar geometry and shade are DataFrames; Catalyst plans the work.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Kernels travel to the executors by value, so that these need no copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
