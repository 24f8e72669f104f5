"""Operators for preparing training text; nothing else in the library imports this package.

Their Python functions travel to the executors by value, so the package has to be installed on the
driver only.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
