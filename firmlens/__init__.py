"""firmlens: firmographic segmentation on PySpark.

One row is one company.  Every operator takes a DataFrame and returns a
DataFrame (or a small fitted model that transforms DataFrames); the row data
never leaves the executors.
"""

import sys

from pyspark import cloudpickle

# Ship the small task functions by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
