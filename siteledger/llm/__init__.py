"""Operators for preparing language-model training data.

Functions that run inside Python workers are shipped with the job (pickled by value), so
executors need numpy and pyarrow but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
