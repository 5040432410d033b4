"""Operators of a training-data pipeline (see README.md, "Training data").

Nothing else in ``tandem`` imports this package.  The functions that run
inside Spark tasks are shipped by value, so executors need no copy of the
package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
