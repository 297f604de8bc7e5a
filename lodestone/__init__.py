"""lodestone: grounded-retrieval analytics as declarative Spark plans."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: they need no copy of it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
