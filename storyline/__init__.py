"""Narrative timelines and media-catalog jobs as Spark DataFrame operators.

Every operator is a function from DataFrames to a DataFrame (or from Columns
to a Column).  The sub-packages are

* ``functions``  column expressions,
* ``operators``  DataFrame operators,
* ``sources``    readers and writers,
* ``plans``      end-to-end jobs composed of operators,
* ``streaming``  Structured Streaming twins,
* ``registry``   the checked queries over the shared test tables.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Ship the package's own functions with the tasks, so that executors need no
# installed copy of it.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
