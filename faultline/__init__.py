"""Fault detection over multivariate sensor recordings, as DataFrame-to-DataFrame operators."""

import sys

from pyspark.cloudpickle import cloudpickle

# Functions shipped to executors carry their code along, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
