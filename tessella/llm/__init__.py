"""Operations of a training-data pipeline over tables of documents, pages and vectors.

Functions of this subpackage travel to the executors by value, so that a
cluster needs no copy of the package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
