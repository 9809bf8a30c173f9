"""Analytics over social-media text and monthly interaction networks, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python workers need no copy of the package: what a task calls travels with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEY = ("graph_id", "month_start")
"""Every network table is keyed by graph and period; all periods are computed in one job."""
