"""treesift: source trees as Spark tables, detection rules as column expressions."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Arrow helpers travel with the plan, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
