"""Training-data operators. Nothing else in the library imports this package.

Python workers get its functions by value (cloudpickle), so executors need
numpy and pyarrow but no copy of this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
