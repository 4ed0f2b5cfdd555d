"""claimweave: claim-document intake, extraction handling and validation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers are sent by value, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
