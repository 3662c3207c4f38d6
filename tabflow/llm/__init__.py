"""Operators for preparing large text corpora for model training (one module per operator) and their queries.

Task functions of this package travel to the executors by value, so a cluster needs no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
