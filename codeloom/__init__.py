"""codeloom: source code as tables, queried with Spark.

Functions that run on executors are pickled by value, so that a cluster needs no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
