"""Cohort stratification over assessment tables, as DataFrame-to-DataFrame operators.

A *subject* is seen at several *observations* (one row each) per *instrument*;
an instrument has *items* that roll up into *subscales* and *scales*.  Every
operator takes DataFrames plus explicit configuration and returns a lazy
DataFrame, unless its docstring names the small action it runs.
"""

import sys

from pyspark import cloudpickle

# Python helpers that run inside tasks travel with the job, so executors need
# no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
