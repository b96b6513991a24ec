"""Market-data analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns DataFrames. A frame holds many instruments at once;
``key`` names the columns that tell one series from another, and order is always a column.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions passed to Python workers travel with the job; executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
